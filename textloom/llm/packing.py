"""Packing of documents' token ids into sequences of a fixed length, by bin completion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bin_completion import SEARCHES, Search, complete
from textloom.llm.shared import per_worker, slices, table, write_table

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together. Each such bucket leaves at most about one sequence part empty.
BUCKET_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Code points below this have had their Unicode classes for so long that both tokenizer libraries split alike.
COMMON = 0x250


def load_tokenizer(path: str):
    """Text to ids by the vocabulary at path (JSON of the tokenizers library), strings of added tokens as ordinary text.

    Where the same vocabulary lies beside it as ranks, the faster library encodes texts of common letters; it gives
    the same ids there (tests compare them). Any other text goes to the tokenizers library itself.
    """
    import base64
    import os
    import re

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rare = re.compile(f"[^\x00-{chr(COMMON - 1)}]")
    return lambda text: exact.encode(text, add_special_tokens=False).ids if rare.search(text) else fast.encode_ordinary(text)


def load_encoder(path: str):
    """Text to the ids that the JSON tokenizer gives as it is: an added token's string in a text is that token."""
    from tokenizers import Tokenizer

    plain, ordinary = Tokenizer.from_file(path), load_tokenizer(path)
    added = [token.content for token in plain.get_added_tokens_decoder().values()]
    return lambda text: plain.encode(text, add_special_tokens=False).ids if any(x in text for x in added) else ordinary(text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: the ids of a text and the end id, cut into pieces of the capacity, the first shorter.

    tokenizer: a path that executors can open. with_ids adds the ids themselves (ids, little-endian unsigned 32 bits).
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        encode = per_worker(f"tokenizer {path}", lambda: load_encoder(path))
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                start = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[start:end].tobytes()
                    for column, value in zip(out, (doc_id, piece, start, end - start, zlib.crc32(part), part if with_ids else None)):
                        column.append(value)
                    start = end
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES, searches: tuple[Search, ...] = SEARCHES) -> DataFrame:
    """pieces (a written table) with sequence_id and offset.

    Pieces are dealt to buckets of about bucket_pieces by a hash of document, piece and row, so that neither a long
    document nor many of one length nor a row repeated any number of times meet in one task; each bucket is packed alone
    by the searches (EXACT for a proven optimum). pieces is read twice.
    """
    buckets = max(1, round(pieces.count() / bucket_pieces))

    def pack(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = bucket.column("length").to_pylist()
        waiting: dict[int, list[int]] = {}
        for k in range(len(lengths) - 1, -1, -1):
            waiting.setdefault(lengths[k], []).append(k)
        places, offsets, at = [0] * len(lengths), [0] * len(lengths), bucket.column("bucket")[0].as_py() << 32
        full = waiting.pop(capacity, [])
        for n, bin_ in enumerate([*([capacity] for _ in full), *complete([lengths[k] for own in waiting.values() for k in own], capacity, searches)]):
            offset = 0
            for length in bin_:
                k = (full if length == capacity else waiting[length]).pop()
                places[k], offsets[k] = at + n, offset
                offset += length
        return bucket.append_column("sequence_id", pa.array(places, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["bucket"])

    names = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(pack, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, searches: tuple[Search, ...] = SEARCHES) -> DataFrame:
    """All documents in as few sequences of at most capacity ids as the search finds; one row for each piece.

    - Ids are whole numbers or what casts to them; give others a number first.
    - Null and empty texts are one end id. A text of any length is cut, never shortened.
    - Repeated rows are packed as often as they occur; a null id is kept.
    - No rows give no rows; other columns are ignored, whatever their names.
    """
    return pack_pieces(write_table(cut_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces"), capacity, searches=searches)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
