"""Texts that stop before their end (problem 8).

Prefix evidence: all distinct texts are sorted; if any text continues another,
then that other's successor does, so one look ahead finds every text with a
longer copy, whatever the size of a group with equal beginnings.  The order puts
letters and digits before all other characters: of all continuations the
successor is one that goes on inside the word, if there is any.  Such a longer
copy proves the cut, and so does one that goes on anywhere else if the last word
is not one that ends texts of the source.

Most cut texts have no longer copy, so two kinds of evidence from all texts of
the source follow: the last word hardly ever ends a text of that source (or is
the beginning of a much more frequent word), or a cut marker stands at a length
at which the texts with that marker pile up, which is the source's limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.mixing import plain_source
from sightline.session import Scratch

# fixed values: what systems append to a text that they have cut
MARKER = r"(?:\.\.\.|…|\[(?:more|cut|truncated|…|\.\.\.)\]|\((?:more|cut|truncated)\))$"
# characters after which a text may end; elsewhere the last word must be one that ends texts
CLOSING = r"[.!?…\"'”“’»)\]}\p{So}\p{Sk}\p{Cf}\p{M}]$"
# a word ends texts if that share of its uses, and that share of the source's texts (and 2 others), do
END_SHARE, TEXT_SHARE, OTHERS = 0.08, 0.0005, 2
# a mark closes texts of a source if that share of them ends in it
MARK_SHARE = 0.05
# a last line of up to five words that so many texts of the source share signs them
LINE_SHARE = 0.001
# a word is a fragment if words that it begins are so many times as frequent
FRAGMENT = 20
# a closed word never ends a line: so many uses, less than that share of ends
NEVER_USES, NEVER_SHARE = 500, 0.002
# a limit: so many texts with the marker, and that share of them, have one length
LIMIT_TEXTS, LIMIT_SHARE = 3, 0.25
# shorter texts without a closing mark are titles, in sources where that share of the texts closes
# and their last word ends a text in that share of its uses
TITLE_CHARS, CLOSED_SHARE, TITLE_SHARE = 48, 0.5, 0.02
# white space as the endings see it, and characters at the end that they look at first
SPACES, TAIL = " \t\n\x0b\f\r\u00a0", 256
# for the order: blanks and marks of plain text, moved behind all letters
MARKS = "".join(map(chr, [*range(1, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA0, 0xAB, 0xBB, *range(0x2010, 0x2027)]))
BEHIND = "".join(chr(0xF0000 + i) for i in range(len(MARKS)))
# words that a task counts before it passes them on
HELD_WORDS = 200_000
# longer words (encoded data) have no fragments, nor have words used once
WORD_CHARS = 64


def _looks_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: texts that their successor continues, and both ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("body", pa.string()), ("goes_on", pa.string())])
    last = None
    for batch in batches:
        rows = []
        for h1, h2, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if last is None:
                rows.append((1, part, h1, h2, body, None))
            elif body.startswith(last[2]) and body != last[2]:
                rows.append((0, part, last[0], last[1], None, body[len(last[2])]))
            last = (h1, h2, body)
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema)
    if last is not None:
        yield pa.RecordBatch.from_pydict({"kind": [2], "part": [part], "h1": [last[0]], "h2": [last[1]], "body": [last[2]], "goes_on": [None]}, schema)


def longer_copies(bodies: DataFrame) -> DataFrame:
    """``(h1, h2, goes_on)``: hashes of each distinct ``body`` that another one continues,
    with the character that follows in a longer one, a letter or digit if one does in any."""
    scratch = Scratch(bodies.sparkSession)
    once = bodies.select(F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("b"), "body").alias("h2"), F.translate("body", MARKS, BEHIND).alias("body")).distinct()
    seen = scratch.write(
        once.repartitionByRange("body").sortWithinPartitions("body").mapInArrow(
            _looks_ahead, "kind int, part int, h1 long, h2 long, body string, goes_on string"),
        "prefixes",
    )
    # two rows for each partition: its first and last text
    edge = Window.orderBy("part", "kind")
    ends = seen.where("kind > 0").withColumn("nxt", F.lead("body").over(edge)).where("kind = 2")
    across = ends.where(F.col("nxt").startswith(F.col("body")) & (F.col("nxt") != F.col("body"))).select(
        "h1", "h2", F.substring("nxt", F.length("body") + 1, F.lit(1)).alias("goes_on"))
    found = seen.where("kind = 0").select("h1", "h2", "goes_on").union(across)
    return found.withColumn("goes_on", F.translate("goes_on", BEHIND, MARKS))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts with their uses and text ends, counted per task before anything is shuffled."""
    digits = bytes.maketrans(b"123456789", b"000000000")
    uses: dict[str, Counter] = {}
    ends: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(s, w.decode(), n, ends[s][w]) for s, ws in uses.items() for w, n in ws.items()]
        uses.clear()
        ends.clear()
        names = ["source", "word", "uses", "ends"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # bytes are split at ASCII white space only, as the last word is found
            words = body.encode().translate(digits).split()
            if words:
                uses.setdefault(source, Counter()).update(words)
                ends.setdefault(source, Counter())[words[-1]] += 1
        if sum(map(len, uses.values())) > HELD_WORDS:
            yield flush()
    if uses:
        yield flush()


def _word_stats(texts: DataFrame, lasts: DataFrame) -> DataFrame:
    """Uses, text ends and longer words of the words in ``lasts(source, word)``."""
    counted = texts.select("source", "body").mapInArrow(_words_of, "source string, word string, uses long, ends long")
    counts = counted.groupBy("source", "word").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends"))
    counts = Scratch(texts.sparkSession).write(counts, "words")
    short = counts.where((F.length("word") <= WORD_CHARS) & (F.col("uses") > 1))
    begun = short.select(
        "source", "uses",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.struct(
            F.substring("word", F.lit(1), i).alias("word"), F.substring("word", i + 1, F.lit(1)).alias("next")))).alias("p"),
    ).select("source", F.col("p.word").alias("word"), F.col("p.next").alias("next"), "uses").where(F.col("next").rlike(r"^[\p{L}\p{N})\];]$"))
    longer = begun.groupBy("source", "word").agg(F.sum("uses").alias("longer_uses"))
    return (
        lasts.join(counts, ["source", "word"], "left").join(longer, ["source", "word"], "left")
        .select("source", "word", F.coalesce("uses", F.lit(1)).alias("uses"), F.coalesce("ends", F.lit(0)).alias("ends"),
                F.coalesce("longer_uses", F.lit(0)).alias("longer_uses"))
    )


def judged_texts(docs: DataFrame) -> DataFrame:
    """Every text with its evidence: ``(doc_id, source, by_copy, by_ending, by_limit, truncated)``.

    Sources are compared without case and surrounding blanks; a null source is
    one of its own.  Null and blank texts are not truncated.  Copies of a text
    are judged alike.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = scratch.write(
        docs.select("doc_id", F.coalesce(plain_source("source"), F.lit("")).alias("source"),
                    F.rtrim("text", F.lit(SPACES)).alias("body"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")),
        "texts",
    )
    # endings are looked for in the last characters; only where these hold no break, in the whole text
    tail = F.expr(f"right(body, {TAIL})")
    ending = lambda brk: F.when(tail.rlike(brk) | (F.length("body") <= TAIL), tail).otherwise(F.col("body"))
    last_line = ending(r"\n")
    closed = F.regexp_replace(tail, "&quot;$", '"')
    known = texts.where("body <> ''").select(
        "doc_id", "source", "body", "chars", "bytes", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("b"), "body").alias("h2"),
        F.regexp_extract(tail, MARKER, 0).alias("marker"),
        F.translate(F.regexp_extract(ending(r"\s"), r"(\S+)$", 1), "123456789", "000000000").alias("word"),
        F.when(last_line.rlike(r"\n\s*\S+(?: \S+){0,4}$"), F.regexp_replace(F.substring_index(last_line, "\n", -1), "[0-9]", "0")).alias("line"),
        closed.rlike(CLOSING).alias("closes"), F.substring("body", -1, 1).alias("last"),
    )
    slim = scratch.write(known.drop("body"), "slim")
    copies = longer_copies(known.select("body"))
    stats = _word_stats(texts.where("body <> ''"), slim.select("source", "word").distinct())
    sizes = slim.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("closes").alias("closed"))

    # a mark in which many texts of the source end, such as a log's semicolon, closes there
    marks = (
        slim.where(~F.col("last").rlike(r"[\p{L}\p{N}\s]")).groupBy("source", "last").agg(F.count("*").alias("m")).join(sizes, "source")
        .where(F.col("m") >= MARK_SHARE * F.col("texts")).select("source", "last", F.lit(True).alias("usual"))
    )

    marked = slim.where("marker <> ''")
    per = marked.groupBy("source", "marker").agg(F.count("*").alias("all"))
    limits = None
    for unit in ("chars", "bytes"):
        at = (
            marked.groupBy("source", "marker", unit).agg(F.count("*").alias("n")).join(per, ["source", "marker"])
            .where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("all")))
            .select("source", "marker", F.lit(unit).alias("unit"), F.col(unit).alias("size"))
        )
        limits = at if limits is None else limits.union(at)
    by_limit = marked.join(
        limits, ["source", "marker"]
    ).where(F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes")) == F.col("size")).select("doc_id").distinct()

    # a signature: the last line, of few words, as a whole
    lines = slim.where("line is not null").groupBy("source", "line").agg(F.count("*").alias("alike"))
    signed = (F.col("alike") - 1 >= F.greatest(F.lit(OTHERS), F.col("texts") * LINE_SHARE)) & (F.col("longer_uses") < FRAGMENT * F.col("uses"))

    ends_texts = (
        (F.col("ends") - 1 >= F.greatest(F.lit(OTHERS), F.col("texts") * TEXT_SHARE))
        & (F.col("ends") >= END_SHARE * F.col("uses")) & (F.col("longer_uses") < FRAGMENT * F.col("uses"))
    )
    never = (F.col("uses") >= NEVER_USES) & (F.col("ends") < NEVER_SHARE * F.col("uses"))
    fragment = F.col("longer_uses") >= FRAGMENT * F.col("uses")
    title = (F.col("chars") < TITLE_CHARS) & (F.col("closed") >= CLOSED_SHARE * F.col("texts")) & ~fragment & F.col("last").rlike(r"[\p{L}\p{N}]") & (F.col("ends") >= TITLE_SHARE * F.col("uses"))
    closing = F.col("closes") | F.coalesce("usual", F.lit(False))
    broken = F.when(F.col("last") == "�", True).when(closing, never | (fragment & (F.col("last") == "."))).otherwise(~ends_texts & ~title & ~F.coalesce(signed, F.lit(False)))
    inside = F.col("last").rlike(r"[\p{L}\p{N}]") & F.coalesce(F.col("goes_on").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    continued = F.col("goes_on").isNotNull() & ~closing & ~ends_texts
    return (
        slim.join(stats, ["source", "word"]).join(sizes, "source").join(lines, ["source", "line"], "left").join(marks, ["source", "last"], "left")
        .join(copies, ["h1", "h2"], "left").join(by_limit.withColumn("limited", F.lit(True)), "doc_id", "left")
        .select("doc_id", "source", (inside | continued).alias("by_copy"), (broken & (F.col("marker") == "")).alias("by_ending"), F.coalesce("limited", F.lit(False)).alias("by_limit"))
        .withColumn("truncated", F.col("by_copy") | F.col("by_ending") | F.col("by_limit"))
        .union(texts.where("coalesce(body, '') = ''").select("doc_id", "source", *[F.lit(False)] * 4))
    )


def truncated_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that were cut off."""
    return judged_texts(docs).where("truncated").select("doc_id")


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """``(source, documents, truncated, truncated_share)`` over all documents of a source."""
    return judged_texts(docs).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"),
        (F.count_if("truncated") / F.count("*")).alias("truncated_share"),
    )
