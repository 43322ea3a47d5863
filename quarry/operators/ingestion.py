"""From page layouts to chunks: layout lines, headings, sections, questions, splits, merges, overlap.

A layout is rows of (document_id, page_no, reading_order, block_type, content, confidence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text

TARGET, MOST, MERGE, OVERLAP = 500, 800, 100, 80
#: Where a long segment may be cut: after a sentence or a line.
BREAK = r"[。！？；\n]|[.!?]\s"


def layout_of(documents: DataFrame, content: str = "text", confidence: float = 0.98) -> DataFrame:
    """A text's lines as text blocks, trimmed, without empty ones, in reading order."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(content), F.lit("")), "\n"), text.stripped), lambda x: x != "")
    # outer: of the inner form Spark infers a filter that finds the lines a second time
    block = documents.select("document_id", "page_no", F.posexplode_outer(lines).alias("reading_order", "content")).where(F.col("content").isNotNull())
    kind = F.when(text.is_formula(F.col("content")), "formula").otherwise("text")
    return block.withColumns({"block_type": kind, "confidence": F.lit(confidence)})


def page_class(chars: Column, images: Column) -> Column:
    return F.when(chars >= 80, "digital").when((images > 0) & (chars < 20), "scanned").otherwise("digital")


# What the start of a heading looks like in a layout.
MARKED = [r"^第[一二三四五六七八九十\d]+章", r"^第[一二三四五六七八九十\d]+节", r"^\d+(?:\.\d+){0,2}\s+\S", r"^[一二三四五六七八九十]、", r"^[（(][一二三四五六七八九十][)）]"]


def marked_headings(content: Column) -> Column:
    """Short lines that look like a heading get the mark."""
    t = text.stripped(content)
    return F.when((F.length(t) <= 50) & t.rlike("|".join(MARKED)), F.concat(F.lit(text.MARK), t)).otherwise(content)


# What the OCR engine calls a block, and its type here.
OCR_TYPES = {"text": "text", "paragraph": "text", "title": "text", "formula": "formula", "table": "table", "figure": "figure", "image": "figure"}


def ocr_type(raw: Column) -> Column:
    """The type of an engine's block; unknown ones are text."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in OCR_TYPES.items() for x in kv])[raw], F.lit("text"))


def ocr_blocks(raw: DataFrame) -> DataFrame:
    """OCR items (type, text, bbox of 4 or 8 numbers, confidence) as blocks: the bounding rectangle, the type, table text."""
    box = F.col("bbox")
    xs, ys = F.filter(box, lambda x, i: i % 2 == 0), F.filter(box, lambda x, i: i % 2 == 1)
    rect = F.when(F.size(box) == 4, box).when(F.size(box) == 8, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(F.array(*[F.lit(0.0)] * 4))
    kind = ocr_type(F.col("type"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return raw.select("document_id", "page_no", "reading_order", rect.alias("bbox"), kind.alias("block_type"), F.when(kind == "table", text.table_text(body)).otherwise(body).alias("content"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def page_text_of(blocks: DataFrame) -> DataFrame:
    """Each page's text in reading order and its mean confidence, four places (no blocks: none)."""
    line = F.when(text.stripped(F.col("content")) != "", F.struct("reading_order", text.stripped(F.col("content")).alias("t")))
    return blocks.groupBy("document_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"), F.bround(F.avg("confidence"), 4).alias("confidence")
    )


def reviews(blocks: DataFrame, least: float = 0.8) -> DataFrame:
    """Blocks of low confidence, and what kind of review they need."""
    return blocks.where(F.col("confidence") < least).withColumn("kind", F.when(F.col("block_type") == "formula", "formula").otherwise("ocr_text"))


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks, of which the first that a table's box overlaps on its page gives way to the table.

    Both have ``bbox``; an equi-join on document and page, with the box test as a filter. Document, page and number tell tables apart.
    """
    b, t = F.col("b.bbox"), F.col("t.bbox")
    hit = ~((b[2] < t[0]) | (t[2] < b[0]) | (b[3] < t[1]) | (t[3] < b[1]))
    at = ["document_id", "page_no"]
    own, ts = blocks.select(*at, "reading_order", "bbox").alias("b"), tables.select(*at, "table_no", "bbox").alias("t")
    first = own.join(ts, at).where(hit).groupBy(*at, "table_no").agg(F.min("reading_order").alias("reading_order"))
    first = first.groupBy(*at, "reading_order").agg(F.min("table_no").alias("table_no"))
    # contents join the few blocks that give way, instead of going with every pair
    first = first.join(tables.select(*at, "table_no", F.struct("content", "bbox").alias("new")), [*at, "table_no"]).drop("table_no")
    joined = blocks.join(first, ["document_id", "page_no", "reading_order"], "left")
    new = F.col("new").isNotNull()
    return joined.withColumns({
        "content": F.coalesce("new.content", "content"), "bbox": F.coalesce("new.bbox", "bbox"),
        "block_type": F.when(new, "table").otherwise(F.col("block_type")), "confidence": F.when(new, 0.9).otherwise(F.col("confidence")),
    }).drop("new")


def sections(layout: DataFrame) -> DataFrame:
    """document_id, page_no, section_no, heading, level, paragraphs: headings of level 1 and 2 open a section of their page.

    Small headings and text are its paragraphs, a formula also as one with a mark; tables and
    figures are apart. A section with a heading but no paragraph stays only at a page's end.
    """
    body = layout.where(~F.col("block_type").isin("table", "figure"))
    level = F.when(F.col("block_type") == "formula", 0).otherwise(text.heading_level(F.col("content")))
    w = W.partitionBy("document_id", "page_no").orderBy("reading_order")
    of = body.withColumn("level", level).withColumn("opens", F.col("level").isin(1, 2)).withColumn("section_no", F.sum(F.col("opens").cast("int")).over(w))
    para = F.when(~F.col("opens"), F.struct("reading_order", F.when(F.col("block_type") == "formula", F.concat(F.lit("[公式] "), "content")).otherwise(F.col("content")).alias("p")))
    found = of.groupBy("document_id", "page_no", "section_no").agg(
        F.max(F.when(F.col("opens"), F.replace("content", F.lit(text.MARK), F.lit("")))).alias("heading"), F.coalesce(F.max(F.when(F.col("opens"), F.col("level"))), F.lit(1)).alias("level"),
        F.transform(F.array_sort(F.collect_list(para)), lambda x: x["p"]).alias("paragraphs"),
    )
    last = F.max("section_no").over(W.partitionBy("document_id", "page_no"))
    return found.withColumn("last", last).where((F.size("paragraphs") > 0) | (F.col("section_no") == F.col("last"))).drop("last")


def questions(layout: DataFrame) -> DataFrame:
    """document_id, page_no, question_no, body, type, stem, options, answer, confidence, score, hints of each exam question.

    A question is a start line and the lines up to the next; a number met again on its
    page goes, with its lines.
    """
    start = F.col("content").rlike(text.QUESTION_START)
    w = W.partitionBy("document_id", "page_no").orderBy("reading_order")
    lines = layout.where("block_type <> 'figure'").withColumn("starts", start).withColumn("no", F.sum(F.col("starts").cast("int")).over(w)).where("no > 0")
    mark = F.regexp_extract("content", text.QUESTION_START, 0)
    lines = lines.withColumn("line", F.when(F.col("starts"), text.stripped(F.expr("substring(content, length(regexp_extract(content, '" + text.QUESTION_START.replace("\\", "\\\\") + "', 0)) + 1)"))).otherwise(F.col("content")))
    lines = lines.withColumn("question_no", F.when(F.col("starts"), F.regexp_extract(mark, text.QUESTION_NUMBER, 0)))
    each = lines.groupBy("document_id", "page_no", "no").agg(F.max("question_no").alias("question_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "line"))), lambda x: x["line"]), "\n").alias("body"))
    nth = F.row_number().over(W.partitionBy("document_id", "page_no", "question_no").orderBy("no"))
    body = text.stripped(F.col("body"))
    return each.withColumn("nth", nth).where("nth = 1").withColumn("body", body).where("body <> ''").select(
        "document_id", "page_no", "question_no", "body", text.question_type(F.col("body")).alias("type"), text.clean_stem(F.col("body")).alias("stem"), text.options(F.col("body")).alias("options"),
        text.answer(F.col("body")).alias("answer"), text.answer_confidence(F.col("body")).alias("confidence"), text.score(F.col("body")).alias("score"), text.hints(F.col("body")).alias("hints"),
    )


def answer_review(answer: Column, confidence: Column, least: float = 0.8) -> Column:
    return F.when(F.coalesce(answer, F.lit("")) == "", "missing_answer").when(confidence < least, "low_confidence")


def exam_pages(layout: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with is_exam: their page holds a question."""
    pages = found.select("document_id", "page_no").distinct().withColumn("is_exam", F.lit(True))
    return layout.join(pages, ["document_id", "page_no"], "left").withColumn("is_exam", F.coalesce("is_exam", F.lit(False)))


_BREAK = re.compile(BREAK)


def cut(t: str, target: int = TARGET, most: int = MOST) -> Iterator[str]:
    """Pieces of a long segment.

    Without any break: ``most`` characters every ``target``. Else each piece ends at the
    first break between target and most characters on; failing that, at the first break at
    all within twice the target; failing that, there.
    """
    if len(t) <= most:
        yield t
        return
    ends = [m.end() for m in _BREAK.finditer(t)]
    if not ends:
        for i in range(0, len(t), target):
            yield t[i : i + most]
        return
    at, low = 0, 0
    while at < len(t):
        while low < len(ends) and ends[low] <= at:
            low += 1
        limit = min(at + 2 * target, len(t))
        early = ends[low] if low < len(ends) and ends[low] < limit else limit
        end, i = early, low
        while i < len(ends) and ends[i] <= at + most:
            if ends[i] >= at + target:
                end = ends[i]
                break
            i += 1
        if piece := t[at:end].strip():
            yield piece
        at = end


def _splitter(target: int, most: int):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(cut(t or "", target, most)))

    return run


def merge_groups(lengths: list[int], pages: list, kinds: list, single: list[bool], most: int = MOST, merge: int = MERGE) -> list[int]:
    """For each piece the number of the chunk it is in. ``single`` pieces (headings) take in none, and with a null kind none joins them either."""
    out, size = [], 0
    for i, n in enumerate(lengths):
        sep = int(kinds[i] == "formula")
        if i and size < merge and not single[i - 1] and kinds[i] is not None and kinds[i] == kinds[i - 1] and pages[i] == pages[i - 1] and size + n <= most:
            out.append(out[-1])
            size += n + sep
            single[i] = False
        else:
            out.append(i)
            size = n
    return out


def _merger(most: int, merge: int):
    """For arrays of pieces without their texts, of which only the length counts."""

    @F.pandas_udf("array<int>")
    def run(pieces: pd.Series) -> pd.Series:
        def one(ps) -> list[int]:
            return merge_groups([p["n"] for p in ps], [p["page_no"] for p in ps], [None if p["exam"] else p["kind"] for p in ps], [p["heading"] or p["exam"] for p in ps], most, merge)

        return pieces.map(one)

    return run


def overlapped(body: Column, before: Column, overlap: int = OVERLAP) -> Column:
    """A chunk after the end of the one before it, whose leading marks go if half of it is left."""
    tail = F.right(before, F.lit(overlap))
    clean = F.regexp_replace(tail, "^[，。！？；：、,.;:!? \\t\\n]+", "")
    return F.when(tail.isNull(), body).otherwise(F.concat(F.when(F.length(clean) < overlap // 2, tail).otherwise(clean), F.lit("\n"), body))


def chunks(segments: DataFrame, target: int = TARGET, most: int = MOST, merge: int = MERGE, overlap: int = OVERLAP) -> DataFrame:
    """document_id, position, page_no, kind, content, chunk_id, content_hash of documents given as segments.

    ``segments`` has for each document an array of (text, page_no, kind, heading, exam) in order. Long ones are split, a
    short one takes in its successor of the same page and kind while both fit, each chunk starts with the end of
    the one before, heading marks go. Only the search for breaks and the merge, whose decisions
    depend on the ones before, are Python.
    """
    piece = lambda s, t: F.struct(t.alias("text"), s["page_no"].alias("page_no"), s["kind"].alias("kind"), s["heading"].alias("heading"), s["exam"].alias("exam"))
    ordered = segments.select("document_id", F.posexplode("segments").alias("seg", "s"))
    long = (F.length("s.text") > most) & ~F.col("s.exam")
    parts = ordered.withColumn("parts", F.when(long, _splitter(target, most)(F.when(long, F.col("s.text")))).otherwise(F.array("s.text")))
    lists = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seg", F.transform("parts", lambda t: piece(F.col("s"), t)).alias("p")))).alias("all"))
    own = lists.select("document_id", F.flatten(F.transform("all", lambda x: x["p"])).alias("pieces"))

    shapes = F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("n"), p["page_no"].alias("page_no"), p["kind"].alias("kind"), p["heading"].alias("heading"), p["exam"].alias("exam")))
    grouped = own.withColumn("gid", _merger(most, merge)(shapes)).select("document_id", F.posexplode(F.arrays_zip("pieces", "gid")).alias("at", "z"))
    line = F.array_sort(F.collect_list(F.struct("at", "z.pieces.text")))
    joined = grouped.groupBy("document_id", F.col("z.gid").alias("gid")).agg(line.alias("lines"), F.first("z.pieces.page_no").alias("page_no"), F.first("z.pieces.kind").alias("kind"))
    body = F.when(F.col("kind") == "formula", F.array_join("lines.text", "\n")).otherwise(F.array_join("lines.text", ""))
    merged = joined.select("document_id", "gid", "page_no", "kind", body.alias("body")).where(text.stripped(F.col("body")) != "")
    w = W.partitionBy("document_id").orderBy("gid")
    content = F.regexp_replace(overlapped(F.col("body"), F.lag("body").over(w), overlap), r"\[HEADING\] ?", "")
    flat = merged.select("document_id", (F.row_number().over(w) - 1).alias("position"), "page_no", "kind", content.alias("content"))
    doc = F.col("document_id").cast("string")
    return flat.withColumns({"chunk_id": F.sha2(F.concat_ws(":", doc, F.col("position").cast("string")), 256), "content_hash": F.sha2(F.col("content").cast("binary"), 256)})


def segments_of(layout: DataFrame, exam: Column | None = None) -> DataFrame:
    """Each document's blocks with content as an array of segments in order."""
    seg = F.struct(
        F.col("page_no").cast("int").alias("p"), "reading_order",
        F.struct(F.col("content").alias("text"), F.col("page_no").cast("int").alias("page_no"), F.when(F.col("block_type") == "formula", "formula").otherwise("text").alias("kind"), F.col("content").startswith("[HEADING]").alias("heading"), (exam if exam is not None else F.lit(False)).alias("exam")).alias("s"),
    )
    return layout.where(text.stripped(F.col("content")) != "").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(seg)), lambda x: x["s"]).alias("segments"))
