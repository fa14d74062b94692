"""Blocks and Markdown: rendering, and chunks within a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from leafmill.functions import text as T
from leafmill.operators import lines as L
from leafmill.operators import tables


def block_markdown() -> Column:
    """The Markdown of one block, by its kind."""
    level = F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(6))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)))
    table = F.when(F.size("rows") > 0, F.when(F.col("header_rows") > 1, tables.pipe_table(F.col("rows"), 2)).otherwise(tables.pipe_table(F.col("rows"), 1)))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "list_item", F.concat(indent, F.when(F.col("ordered"), "1. ").otherwise("- "), F.col("text")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text")))
        .when(F.col("kind") == "caption", F.concat(F.lit("> **"), F.col("text"), F.lit("**")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("kind") == "hr", "---")
        .when(F.col("kind") == "footnote", F.concat(F.lit("[^"), F.coalesce("src", F.lit("n")), F.lit("]: "), F.col("text")))
        .when(F.col("kind") == "image", F.concat(F.lit("!["), F.col("text"), F.lit("]("), F.col("src"), F.lit(")")))
        .when(F.col("kind") == "table", table)
        .otherwise(T.escape_markdown(F.col("text")))
    )


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    """``key, text``: blocks in order, parted by blank lines."""
    own = blocks.where("kind is not null").select(key, "seq", block_markdown().alias("md"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "md"))), lambda x: x["md"])
    return own.groupBy(key).agg(F.array_join(parts, "\n\n").alias("text"))


def chunks(markdown_: DataFrame, most: int = 200) -> DataFrame:
    """``doc_id, chunk, path, text, tokens, oversize``: blocks packed up to ``most`` tokens.

    A chunk never crosses a heading and begins a new one where the next block
    would go over; a block over the budget by itself is a chunk, marked and
    never cut.  Fenced code is one block.  Tokens are runs of non-space.
    """
    body = T.strip_yaml(F.col("text"))
    rows = L.lines_of(markdown_.select("doc_id", body.alias("text")))
    fences = F.sum(F.col("text").startswith("```").cast("int")).over(L.so_far())
    rows = rows.withColumn("fence", (fences % 2 == 1) | F.col("text").startswith("```"))
    rows = rows.withColumn("head", ~F.col("fence") & F.col("text").rlike("^#{1,6} "))
    blank = (F.trim("text") == "") & ~F.col("fence")
    opens = blank | F.col("head") | F.coalesce(F.lag("head").over(L.by_doc()), F.lit(False)) | (F.col("fence") & ~F.coalesce(F.lag("fence").over(L.by_doc()), F.lit(False)))
    rows = rows.withColumn("blank", blank).withColumn("block", F.sum(opens.cast("int")).over(L.so_far())).where("not blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    blocks = rows.groupBy("doc_id", "block").agg(F.min("seq").alias("seq"), F.max("head").alias("head"), text.alias("text"))
    heads = L.section_paths(L.headings_of(markdown_.select("doc_id", body.alias("text")))).select("doc_id", F.col("seq").alias("section"), "path")
    placed = blocks.withColumn("section", F.max(F.when(F.col("head"), F.col("seq"))).over(L.so_far())).where("not head")
    sized = placed.withColumn("tokens", T.words(F.col("text")))
    packed = sized.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("seq", "tokens", "text"))).alias("blocks"))
    start = F.struct(F.array().cast("array<struct<seq:int,tokens:int,text:string>>").alias("done"), F.lit(None).cast("struct<seq:int,tokens:int,text:string>").alias("now"))

    def add(acc: Column, b: Column) -> Column:
        fits = acc["now"].isNotNull() & (acc["now"]["tokens"] + b["tokens"] <= most)
        more = F.struct(acc["now"]["seq"].alias("seq"), (acc["now"]["tokens"] + b["tokens"]).alias("tokens"), F.concat(acc["now"]["text"], F.lit("\n\n"), b["text"]).alias("text"))
        fresh = F.struct(b["seq"].alias("seq"), b["tokens"].alias("tokens"), b["text"].alias("text"))
        done = F.when(fits | acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(done.alias("done"), F.when(fits, more).otherwise(fresh).alias("now"))

    made = packed.select("doc_id", "section", F.explode(F.aggregate("blocks", start, add, lambda a: F.concat(a["done"], F.array(a["now"])))).alias("c"))
    out = made.join(heads, ["doc_id", "section"], "left").select("doc_id", "c.seq", F.coalesce("path", F.lit("")).alias("path"), "c.text", "c.tokens", (F.col("c.tokens") > most).alias("oversize"))
    return out.withColumn("chunk", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).drop("seq")


#: Bytes of text that a batch of chunks holds, about.
SLICE_BYTES = 1 << 20
_SPACES = " \t\n\x0b\f\r"
_FRONT = re.compile(r"\A---\n(?s:.*?)\n---(?:\n|\Z)")
_GAP = re.compile(r"\n\s*\n", re.ASCII)
_MARK = re.compile("(?:\\A|(?<=[\n\r\x85\u2028\u2029]))\\s*(?:`{3,}|~{3,})", re.ASCII)
_HEAD = re.compile(r"\A(#{1,6})\s+([^\n]+)\Z", re.ASCII)
_RULE = re.compile("\\A[| :\\-]+[\r\x85\u2028\u2029]?\\Z")


def _words(text: str) -> int:
    """As ``functions.text.words``: bytes are parted at ASCII white space only."""
    return len(text.encode().split())


def blocks_of(text: str) -> list[str]:
    """What blank lines part, a code fence whole, front matter left out."""
    pieces = _GAP.split(_FRONT.sub("", text, count=1).strip(_SPACES))
    if "```" not in text and "~~~" not in text:
        return pieces
    blocks: list[list[str]] = []
    inside = False
    for piece in pieces:
        if inside:
            blocks[-1].append(piece)
        else:
            blocks.append([piece])
        inside ^= len(_MARK.findall(piece)) % 2 == 1
    return ["\n\n".join(b) for b in blocks]


def _table_parts(lines: list[str], context: str, most: int) -> Iterator[str]:
    """A table's rows in parts of at most ``most`` tokens, one row at least, each under context and header."""
    header = "\n".join(lines[:2])
    fixed = _words(context) + _words(header)
    rows: list[str] = []
    tokens = 0
    for row in lines[2:]:
        n = _words(row)
        if rows and fixed + tokens + n > most:
            yield "\n".join([context + header, *rows])
            rows, tokens = [], 0
        rows.append(row)
        tokens += n
    yield "\n".join([context + header, *rows])


def chunks_of(text: str, most: int) -> Iterator[tuple[str, str]]:
    """``path, text`` of each chunk of one document, in order."""
    latest: list[tuple[int, str]] = [(0, "")] * 7  # the last heading of that level or above it
    path = ""
    for block in blocks_of(text):
        head = _HEAD.match(block) if block.startswith("#") else None
        if head:
            level = len(head[1])
            latest[level:] = [(level, head[2])] * (7 - level)
            path = " > ".join(title for k, (depth, title) in enumerate(latest[1 : level + 1], 1) if depth == k)
        context = path + "\n\n" if path and not head else ""
        lines = block.split("\n") if block.startswith("|") else []
        if len(lines) >= 3 and _RULE.match(lines[1]):
            for part in _table_parts(lines, context, most):
                yield path, part
        else:
            yield path, context + block


def block_chunks(markdown_: DataFrame, most: int = 200) -> DataFrame:
    """``doc_id, chunk, path, text, tokens, oversize``: a chunk for each block, under its section's path.

    A table of more than ``most`` tokens is parted between rows, each part under
    the table's header; any other block stays whole and is marked.  One pass
    over each text in its row: nothing is shuffled, and a worker holds little
    more than the batch it reads.
    """
    schema = StructType([markdown_.schema["doc_id"], *StructType.fromDDL("chunk int, path string, text string, tokens int, oversize boolean")])
    key = to_arrow_type(schema["doc_id"].dataType)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, numbers, paths, texts = zip(*rows, strict=True)
        tokens = [_words(t) for t in texts]
        columns = [pa.array(ids, key), pa.array(numbers, pa.int32()), pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(tokens, pa.int32()), pa.array([n > most for n in tokens], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for read in batches:
            for i in range(0, read.num_rows, 256):
                few = read.slice(i, 256)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    for number, (path, part) in enumerate(chunks_of(text, most)):
                        rows.append((doc_id, number, path, part))
                        size += len(part) + 100
                        if size > SLICE_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return markdown_.where("text is not null").select("doc_id", "text").mapInArrow(step, schema)


def conversation_documents(turns: DataFrame) -> DataFrame:
    """``doc_id, text``: each conversation as Markdown, a heading for every turn."""
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("md")))), lambda x: x["md"])
    return turns.where("text is not null").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(parts, "\n\n").alias("text"))
