"""Token counts by a separator scan over flat token files.

A token file is a sequence of little-endian ids, documents following each other, each closed by the end-of-document id;
nothing else says where a document begins. The scan reads blocks, finds the separators of a block in one vectorised
comparison, and stitches what blocks leave open by a prefix scan over one row per block: how many separators precede the
block in its file, and how many tokens follow the last of them.
"""

import base64
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.shared import cut, scratch_path

#: Blocks of a file whose running sums are taken first among themselves.
STRIDE = 1024
COUNTED = "file string, doc_no long, n_tokens long"


def separable(ranks: dict[bytes, int], eod: int, dtype: str) -> None:
    """Fails where a text's tokens could hold ``eod``, or where ids don't fit ``dtype``."""
    if eod in ranks.values():
        raise ValueError(f"{eod} is a token of the vocabulary, so it can't separate documents")
    if max(eod, *ranks.values()) > np.iinfo(dtype).max:
        raise ValueError(f"ids of the vocabulary don't fit {dtype}")


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str, eod: int, dtype: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    separable(ranks, eod, dtype)
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_tokens(
    docs: DataFrame, folder: str, ranks_path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2", file_bytes: int = 1 << 28
) -> DataFrame:
    """Encodes whole texts into token files in ``folder``; returns the manifest (file, doc_no, id), checkpointed.

    Files are named by the attempt that wrote them; only those in the manifest count, so lost or repeated tasks do no
    harm. A null or empty text is a document without tokens. ``eod`` must not be a token, and ids have to fit ``dtype``:
    see ``separable``. A new file starts after ``file_bytes``. The rank file is
    read by each worker, so its path has to exist on every machine.
    """

    def work(batches):
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, written, no, name, doc_no = None, 0, 0, "", 0
        end = np.array([eod], dtype=dtype).tobytes()
        encoding = _encoding(ranks_path, pattern, eod, dtype)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                if out is None or written >= file_bytes:
                    if out is not None:
                        out.close()
                    name, written, no, doc_no = f"{stem}-{no:04d}.bin", 0, no + 1, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = np.array(encoding.encode_ordinary(text or ""), dtype=dtype).tobytes() + end
                out.write(data)
                written += len(data)
                rows.append((name, doc_no, key))
                doc_no += 1
            yield pd.DataFrame(rows, columns=["file", "doc_no", "id"])
        if out is not None:
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if kind in ("int", "bigint", "smallint", "tinyint"):  # pandas would turn integers with nulls into floats
        rows = rows.withColumn("id", F.col("id").cast("string"))
        written = rows.mapInPandas(work, "file string, doc_no long, id string")
        return cut(written.select("file", "doc_no", F.col("id").cast(kind).alias(id_col)))
    return cut(rows.mapInPandas(work, f"file string, doc_no long, id {kind}").withColumnRenamed("id", id_col))


def scan(files: DataFrame, folder: str, eod: int, dtype: str = "<u2", block_tokens: int = 1 << 19) -> DataFrame:
    """One row per document of the files (``files``: names in ``folder``): file, doc_no (from 0) and n_tokens, without
    its separator.

    Tokens after a file's last separator are a document too; an empty file has none. A file whose length isn't a whole
    number of tokens fails. Blocks are read by byte range, each by its own row, so a file may be of any length.
    """
    width = np.dtype(dtype).itemsize
    fs_of = lambda: pafs.FileSystem.from_uri(folder)

    def lengths(batches):
        fs, base = fs_of()
        for pdf in batches:
            sizes = [fs.get_file_info(f"{base}/{f}").size for f in pdf["file"]]
            if any(s is None or s % width for s in sizes):
                raise ValueError("a token file is missing or cut within a token")
            yield pd.DataFrame({"file": pdf["file"], "n": [s // width for s in sizes]})

    # few bytes for much work: dealt to tasks by number, not by size
    names = files.select("file").distinct().repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    sized = names.mapInPandas(lengths, "file string, n long").filter("n > 0")
    n_blocks = F.ceil(F.col("n") / block_tokens)
    blocks = cut(sized.select("file", "n", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def separators(batches):
        """A row per block: its separators' places relative to the block, and its length."""
        fs, base = fs_of()
        for pdf in batches:
            for file, n, block in zip(pdf["file"], pdf["n"], pdf["block"]):
                with fs.open_input_file(f"{base}/{file}") as source:
                    source.seek(int(block) * block_tokens * width)
                    data = np.frombuffer(source.read(min(block_tokens, int(n) - int(block) * block_tokens) * width), dtype=dtype)
                at = np.flatnonzero(data == eod)
                yield pd.DataFrame({"file": [file], "block": [block], "size": [len(data)], "at": [at]})

    found = cut(blocks.mapInPandas(separators, "file string, block long, size long, at array<int>"))

    # the prefix scan: an element is (separators, tokens after the last one); adding the next block keeps the sum of the
    # first, and the second restarts where the next block has a separator. Strides are summed first, then blocks in them.
    n_sep = F.size("at").cast("long")
    tail = F.when(F.size("at") > 0, F.col("size") - F.element_at("at", -1) - 1).otherwise(F.col("size"))
    blocks = found.select("file", "block", n_sep.alias("seps"), tail.alias("tail"), F.floor(F.col("block") / STRIDE).alias("stride"))

    def scanned(rows: DataFrame, keys: list[str], order: str, seps: str, tail: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(tail).over(upto)
        rows = rows.withColumn("_total", total)
        # the running total of tails up to the block before the last separator, from where tokens are open
        mark = F.last(F.when(F.col(seps) > 0, F.col("_total") - F.col(tail)), ignorenulls=True).over(before)
        opened = F.coalesce(F.col("_total") - F.col(tail) - F.coalesce(mark, F.lit(0)), F.lit(0))
        return rows.select("*", F.coalesce(F.sum(seps).over(before), F.lit(0)).alias("seps_before"), opened.alias("open_before")).drop("_total")

    inside = scanned(blocks, ["file", "stride"], "block", "seps", "tail")
    ends = Window.partitionBy("file", "stride").orderBy(F.desc("block"))
    per_stride = inside.withColumn("_last", F.row_number().over(ends)).filter("_last = 1").select(
        "file",
        "stride",
        (F.col("seps_before") + F.col("seps")).alias("s_seps"),
        F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open_before") + F.col("tail")).alias("s_tail"),
    )
    across = scanned(per_stride, ["file"], "stride", "s_seps", "s_tail").select(
        "file", "stride", F.col("seps_before").alias("f_seps"), F.col("open_before").alias("f_open")
    )
    last = found.groupBy("file").agg(F.max("block").alias("last_block"))
    placed = inside.join(across, ["file", "stride"]).join(last, "file").select(
        "file",
        "block",
        (F.col("seps_before") + F.col("f_seps")).alias("doc_no"),
        F.when(F.col("seps_before") > 0, F.col("open_before")).otherwise(F.col("open_before") + F.col("f_open")).alias("open"),
        (F.col("block") == F.col("last_block")).alias("is_last"),
    )
    done = found.join(placed, ["file", "block"])
    # each separator closes a document; its tokens reach back to the one before, or over the tokens left open
    closed = F.transform("at", lambda p, i: p - F.coalesce(F.get("at", i - 1) + 1, -F.col("open")))
    rest = F.when(F.size("at") > 0, F.col("size") - F.element_at("at", -1) - 1).otherwise(F.col("size") + F.col("open"))
    all_docs = F.concat(closed, F.when(F.col("is_last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return done.select("file", "doc_no", F.posexplode(all_docs).alias("_i", "n_tokens")).select(
        "file", (F.col("doc_no") + F.col("_i")).alias("doc_no"), F.col("n_tokens").cast("long").alias("n_tokens")
    )


def count(docs: DataFrame, ranks_path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: id and n_tokens. Texts are written to token files in the shared folder and counted by the
    scan; the manifest, which has places but no counts, gives each its id."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, ranks_path, pattern, eod, id_col, text_col)
    counted = scan(manifest, folder, eod, **settings)
    return manifest.join(counted, ["file", "doc_no"]).select(id_col, "n_tokens")
