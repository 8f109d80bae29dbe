"""Token files, and token counts of documents by a scan for separators.

A token file is flat: unsigned 16-bit ids, each document ended by the separator, no index. The scan deals blocks of
the files to tasks, finds separators in each block with numpy, and stitches documents that cross blocks with running
sums over the blocks' summaries. Files lie in the folder that driver and executors share; a task that runs again
writes a file of its own, and only files of finished tasks are in the manifest.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, opened, shared_dir, sliced, texts, written

TOKENIZER = "byte_bpe_50k"
#: <|endoftext|> of that vocabulary, which no encoded text contains.
SEPARATOR = 50256


class Tokenizer:
    """Ids of whole texts, as ``tokenizers`` gives them with add_special_tokens=False.

    The same vocabulary's ranks in tiktoken give the same ids several times faster; texts that hold a special
    token's string, and long unbroken runs, for which merging by ranks is slow, go to ``tokenizers`` itself.
    ``ordinary``: special tokens' strings are ordinary text.
    """

    def __init__(self, name: str = TOKENIZER, ordinary: bool = False) -> None:
        import public_tokenizers
        import tiktoken

        self.file, self.ordinary, self.slow = public_tokenizers.path(f"{name}.json"), ordinary, None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text and not self.ordinary or len(text) > 10_000 and re.search(r"\S{2000}|\s{2000}", text):
            if self.slow is None:
                import tokenizers

                self.slow = tokenizers.Tokenizer.from_file(self.file)
                self.slow.encode_special_tokens = self.ordinary
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.fast.encode_ordinary(text), np.uint16)


def decoded(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts(column)]


#: A document's place in the file of ids beside a token file: the id, and whether there is one.
IDENT = np.dtype([("id", "<i8"), ("there", "u1")])


def token_files(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes one token file a task, and beside it one of its documents' ids in order; a row (file, file_tokens) for each.

    Null and empty texts are documents of no tokens; ids may be null. Repeated rows are documents of their own. An
    empty table gives no files. Texts are taken whole; strings of special tokens are ordinary text.
    """
    folder = shared_dir(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files, n = Tokenizer(tokenizer, ordinary=True), [], 0
        name = f"{folder}/{uuid.uuid4().hex}.tokens"
        try:
            for batch in (part for whole in batches for part in sliced(whole)):
                if not files:
                    store, path = opened(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    files = [store.open_output_stream(path), store.open_output_stream(f"{path}.ids")]
                flat = np.concatenate([x for t in decoded(batch.column(1)) for x in (encoder.ids(t), [SEPARATOR])]).astype("<u2")
                files[0].write(flat.tobytes())
                n += len(flat)
                idents = np.zeros(batch.num_rows, IDENT)
                idents["id"], idents["there"] = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                files[1].write(idents.tobytes())
        finally:
            for out in files:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "file_tokens"])

    slim = docs.select(F.col(ident).cast("long"), F.col(text).cast("string"))
    return written(slim.mapInArrow(write, "file string, file_tokens long"))


def scanned_blocks(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = 4 << 20) -> DataFrame:
    """(file, ends, base, carry) of each block of the files (file, file_tokens).

    ``ends`` are the places of the block's separators, and the file's end if tokens follow the last one. ``base`` is
    the number of documents that end before the block, ``carry`` the place of the last separator before it, or -1.
    """
    sized = files.groupBy("file").agg(F.max("file_tokens").alias("file_tokens")).where("file_tokens > 0")
    blocks = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("file_tokens") - 1).cast("long"), F.lit(block_tokens).cast("long"))))

    def scan(batch: pa.RecordBatch) -> dict:
        ends, last = [], []
        for name, total, at in zip(*(c.to_pylist() for c in batch.columns)):
            store, path = opened(name)
            with store.open_input_file(path) as f:
                f.seek(2 * at)
                block = np.frombuffer(f.read(2 * min(block_tokens, total - at)), "<u2")
            found = np.flatnonzero(block == separator) + at
            if at + len(block) == total and len(block) and block[-1] != separator:
                found = np.append(found, total)
            ends.append(found.tolist())
            last.append(int(found[-1]) if len(found) else None)
        return {"file": batch.column(0), "block": batch.column(2), "ends": ends, "last": last}

    n = sized.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = arrow_map(blocks.select("file", "file_tokens", "block").repartition(int(n), "file", "block"), scan, "file string, block long, ends array<long>, last long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    found = found.withColumn("carry", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)))
    return found.select("file", "ends", "base", "carry")


def separator_scan(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = 4 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document in the files (file, file_tokens), the separator not counted.

    Tokens after a file's last separator are a last document; an empty document is one of no tokens. A file without
    tokens has no documents. Files that are listed twice are scanned once.
    """
    found = scanned_blocks(files, separator, block_tokens)
    starts = F.transform(F.concat(F.array("carry"), "ends"), lambda x: x + 1)
    rows = found.withColumn("starts", starts).select("file", "base", "starts", F.posexplode("ends").alias("pos", "end"))
    rows = rows.withColumn("start", F.element_at("starts", F.col("pos") + 1))
    return rows.select("file", (F.col("base") + F.col("pos")).alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block_tokens: int = 4 << 20) -> DataFrame:
    """(doc_id, n_tokens) of each row of ``docs``: token files are written, then scanned.

    Null and empty texts have no tokens, whole texts are read however long, repeated rows and rows without an id are
    counted each; an empty table gives none. Other columns are ignored. The string of a special token, such as
    <|endoftext|>, counts as ordinary text, which keeps the separator apart from texts: such a text can have more
    tokens here than where its special tokens are single ids. The ids of the documents that end in a block are read
    from the file beside, at the block's place in the running count, so counts and ids are never joined.
    """
    found = scanned_blocks(token_files(docs, ident, text, tokenizer), block_tokens=block_tokens)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ends, base, carry in zip(*(c.to_pylist() for c in batch.columns)):
                if not ends:
                    continue
                store, path = opened(f"{name}.ids")
                with store.open_input_file(path) as f:
                    f.seek(IDENT.itemsize * base)
                    idents = np.frombuffer(f.read(IDENT.itemsize * len(ends)), IDENT)
                n = np.diff(np.array([carry, *ends], np.int64)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(idents["id"]), mask=idents["there"] == 0), pa.array(n)], names=["doc_id", "n_tokens"])

    return found.mapInArrow(counted, "doc_id long, n_tokens long")
