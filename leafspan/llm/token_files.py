"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

File format, two tables in the shared folder, written and read by Spark so that
any store it knows will do:

* ``ids``: a row per block. part and block number it, and blocks in their order hold the
  documents in ascending doc_id; ``doc_ids``, ``nths`` (0 for the first row of an id, 1 for the
  second, ...) and ``lengths`` describe its documents, ``n_tokens`` sums the
  lengths, ``ids`` holds their ids end to end as little-endian unsigned 32-bit
  integers, each document closed by END.
* ``index``: a row per bucket of keys (doc_id, nth). A key's hash chooses its bucket,
  then a pilot; the pilot's number gives the key's slot, without gaps and
  without collisions ("hash and displace": pilots below 0 name a slot outright). A slot
  stores the key's fingerprint (32 bits) and the place of the payload: part, block,
  offset in the block and length, in ids.

Both are filed by shelves (folders) of parts and of buckets. ``fetch`` of some keys reads the index rows
of their buckets, four numbers of a slot each, and the blocks that these name, whatever the corpus's
size; keys that are not in the files are refused by their fingerprints but for
one in four billion. ``lookup`` and ``payloads`` serve tables of keys as long as the corpus.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm import textnum as tn
from leafspan.llm.session import shared_dir, small_batches, total_bytes, unsorted_writes

END = 2
#: Bytes of text per part, ids per block, keys per index bucket (about).
PART_BYTES, BLOCK_IDS, BUCKET_KEYS = 16 << 20, 1 << 20, 20_000
#: Parts and buckets per folder.
PARTS_OF_SHELF, BUCKETS_OF_SHELF = 256, 64
#: Different words whose ids a worker remembers before it starts anew.
REMEMBERED = 2_000_000
#: Words that are kept apart until they are merged with the many.
RECENT = 100_000
#: Words that the tokenizer is handed at a time.
ENCODED = 2048

IDS = "shelf int, part int, block int, doc_ids array<long>, nths array<int>, lengths array<long>, n_tokens long, ids binary"
INDEX = (
    "shelf int, bucket int, keys long, pilots binary, fingerprints binary, part binary, block binary, offset binary, length binary"
)


# White space of the contracts, and marks that stand for it in vocabularies.
WHITE, MARKS = "\t\n\x0b\x0c\r ", "\u0120\u010a\u2581"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts by way of their different words.

    The tokenizer never joins characters across white space, so that the ids of a
    text are those of its words in turn; each word is encoded once and remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._cuts_at_white_space(path)
        self._forget()

    def _cuts_at_white_space(self, path: str) -> None:
        """Raises ValueError for a tokenizer that does not encode each word by itself."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        bare = (token.removesuffix("</w>") for token in self.tokenizer.get_vocab())
        joining = any(len(token) > 1 and any(c in token for c in WHITE + MARKS) for token in bare)
        parts = ["a", "It's", "word", "3.5", "don't,", "\u00e9t\u00e9", "\u4e2d\u6587", "x_y"]
        apart = all(ids(x + white + y) == ids(x) + ids(y) for x in parts for y in parts for white in WHITE)
        if joining or not apart or ids(f" {WHITE}"):
            raise ValueError(f"{path}: tokens span white space")

    def _forget(self):
        # words known by their numbers, sorted: the many, and the recent ones that are not merged yet
        self.known = [self._nothing(), self._nothing()]
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    @staticmethod
    def _nothing():
        return np.zeros(0, tn.U), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        """Encodes new words (sorted numbers) and files them under the recent ones."""
        found: list[list[int]] = []
        for i in range(0, len(words), ENCODED):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + ENCODED], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids.resize(self.used + total + len(self.ids) // 2, refcheck=False)
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        new = (key, (self.used + np.cumsum(size) - size).astype(np.uint32), size.astype(np.uint32))
        self.used += total
        self.known[1] = self._merged(self.known[1], new)
        if len(self.known[1][0]) > RECENT:
            self.known = [self._merged(*self.known), self._nothing()]

    @staticmethod
    def _merged(old, new):
        at = np.searchsorted(old[0], new[0])
        return tuple(np.insert(x, at, y) for x, y in zip(old, new, strict=True))

    def _placed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each number's ids start and how many they are; -1 for unknown ones."""
        start, size = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for known in self.known:
            if len(known[0]):
                at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
                hit = known[0][at] == key
                start[hit], size[hit] = known[1][at[hit]], known[2][at[hit]]
        return start, size

    def encode(self, words: tn.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their ends, number of ids per text)."""
        key, first, inverse = np.unique(words.hashes(tn.EXACT), return_index=True, return_inverse=True)
        start, size = self._placed(key)
        new = np.flatnonzero(start < 0)
        if len(new):
            if sum(len(k[0]) for k in self.known) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(key))
            raw = words.data.tobytes()
            borders = zip(words.first[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            self._learn(key[new], [raw[a:b].decode() for a, b in borders])
            start, size = self._placed(key)
        size = size[inverse]
        flat = self.ids[tn.ranges(start[inverse], size)] if len(size) else np.zeros(0, np.uint32)
        sums = np.concatenate([[0], np.cumsum(size)])
        ends = sums[words.start_of_doc + words.count]
        return np.insert(flat, ends, np.uint32(END)), ends - sums[words.start_of_doc] + 1


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget_encoders() -> None:
    _encoders.clear()


tn.holds(__name__, _forget_encoders)


def _writer(path: str):
    @tn.tidied
    def blocks(batches):
        encoder, part, number = _encoder(path), TaskContext.get().partitionId(), 0
        docs, nths, lengths, ids, held = [], [], [], [], 0
        last, nth = object(), 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([nths], pa.list_(pa.int32())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([held], pa.int64()),
                    pa.array([np.concatenate(ids).astype("<u4").tobytes()], pa.binary()),
                ],
                names=["part", "block", "doc_ids", "nths", "lengths", "n_tokens", "ids"],
            )

        for rows, words in tn.runs(batches):
            got, size = encoder.encode(words)
            for doc in rows.column("doc_id").to_pylist():
                nth = nth + 1 if doc == last else 0
                last = doc
                docs.append(doc)
                nths.append(nth)
            lengths += size.tolist()
            ids.append(got)
            held += len(got)
            if held >= BLOCK_IDS:
                yield block()
                docs, nths, lengths, ids, held, number = [], [], [], [], 0, number + 1
        if docs:
            yield block()

    return blocks


def key_hash(doc_ids: np.ndarray, null: np.ndarray, nths: np.ndarray) -> np.ndarray:
    """A number per key; null ids have keys of their own."""
    own = tn.mix(doc_ids.astype(np.int64).view(tn.U), 21) ^ (null.astype(tn.U) << np.uint64(63))
    return tn.mix(own + nths.astype(tn.U) * np.uint64(0x9E3779B97F4A7C15), 22)


def _slots(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return np.where(
        pilot < 0, -pilot - 1, (tn.mix(h ^ tn.mix(pilot.astype(np.int64).view(tn.U), 31), 32) % np.uint64(max(n, 1))).astype(np.int64)
    )


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each key) for distinct hashes; slots are 0 .. len(h) - 1."""
    n = len(h)
    groups = max(1, n // 3)
    group = (tn.mix(h, 30) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    count = np.bincount(group, minlength=groups)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    pilots, slot, taken = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    tries = np.arange(1, 33)
    for g in np.argsort(-count, kind="stable"):
        if count[g] < 2:
            break
        own = order[first[g] : first[g] + count[g]]
        low = 0
        while True:
            places = _slots(h[own][None, :], np.broadcast_to((tries + low)[:, None], (len(tries), len(own))), n)
            ok = ~taken[places].any(axis=1)
            if count[g] > 1:
                ordered = np.sort(places, axis=1)
                ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(ok)
            if len(hit):
                pilots[g], slot[own] = tries[hit[0]] + low, places[hit[0]]
                taken[places[hit[0]]] = True
                break
            low += len(tries)
    single = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    pilots[single] = -free - 1
    slot[order[first[single]]] = free
    return pilots, slot


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (tn.mix(h, 40) >> np.uint64(32)).astype(np.uint32)


def _keys(table: pa.Table) -> np.ndarray:
    doc = table.column("doc_id")
    null = doc.is_null().to_numpy(zero_copy_only=False) if isinstance(doc, pa.Array) else np.array(doc.is_null().to_pylist(), bool)
    ids = np.array([0 if x is None else x for x in doc.to_pylist()], np.int64)
    return key_hash(ids, null, np.array(table.column("nth").to_pylist(), np.int64))


_INDEX_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("keys", pa.int64())] + [(c, pa.binary()) for c in ("pilots", "fingerprints", "part", "block", "offset", "length")]
)


def _indexed(key, table):
    h = _keys(table)
    pilots, slot = perfect_hash(h)

    def by_slot(values, item):
        out = np.zeros(len(h), item)
        out[slot] = values
        return out.tobytes()

    row = [key[0].as_py(), len(h), pilots.tobytes(), by_slot(_fingerprint(h), np.uint32)]
    row += [by_slot(table.column(c).to_numpy(), np.int64 if c in ("offset", "length") else np.int32) for c in ("part", "block", "offset", "length")]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)).cast("int")


class TokenFiles:
    """An ids table and its index under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(IDS).parquet(f"{self.path}/ids")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def _asked(self, keys: DataFrame) -> DataFrame:
        buckets = self.spark.read.parquet(f"{self.path}/size").first()["buckets"]
        return keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("int")).withColumn("bucket", _bucket(buckets))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, nth, part, block, offset, length) of the keys (doc_id, nth) that the index knows."""
        return self._found(self._asked(keys), self.index())

    def fetch(self, keys: list[tuple[int | None, int]]) -> DataFrame:
        """(doc_id, nth, ids) of some keys (doc_id, nth): the bytes of their ids. Only their buckets and blocks are read.

        Meant for lists that the driver holds. A key that is not in the files has no row; a key that is asked twice has two.
        """
        asked = self._asked(self.spark.createDataFrame(keys, "doc_id long, nth int"))
        buckets = sorted({r["bucket"] for r in asked.select("bucket").collect()})
        shelves = sorted({b // BUCKETS_OF_SHELF for b in buckets})
        index = self.index().filter(F.col("shelf").isin(shelves) & F.col("bucket").isin(buckets))
        places = self._found(asked, index).collect()  # a row per key at most
        blocks = sorted({(r["part"], r["block"]) for r in places})
        wanted = F.col("shelf").isin(sorted({a // PARTS_OF_SHELF for a, _ in blocks})) & F.col("part").isin(sorted({a for a, _ in blocks}))
        wanted = wanted & F.col("block").isin(sorted({b for _, b in blocks}))
        where = self.spark.createDataFrame(places, "doc_id long, nth int, part int, block int, offset long, length long")
        ids = F.substring("ids", F.col("offset").cast("int") * 4 + 1, F.col("length").cast("int") * 4)
        return self.blocks().filter(wanted).select("part", "block", "ids").join(F.broadcast(where), ["part", "block"]).select("doc_id", "nth", ids.alias("ids"))

    def _found(self, asked: DataFrame, index: DataFrame) -> DataFrame:
        names = ["doc_id", "nth", "part", "block", "offset", "length"]

        def found(key, asked, index):
            out = asked.select(["doc_id", "nth"])
            if not index.num_rows or not asked.num_rows:
                hit = np.zeros(asked.num_rows, bool)
                values = [np.zeros(asked.num_rows, np.int64)] * 4
            else:
                row = index.to_pylist()[0]
                h = _keys(asked)
                pilots = np.frombuffer(row["pilots"], np.int32)
                pilot = pilots[(tn.mix(h, 30) % np.uint64(len(pilots))).astype(np.int64)]
                slot = np.minimum(_slots(h, pilot, row["keys"]), row["keys"] - 1)
                hit = np.frombuffer(row["fingerprints"], np.uint32)[slot] == _fingerprint(h)
                values = [np.frombuffer(row[c], t)[slot] for c, t in (("part", np.int32), ("block", np.int32), ("offset", np.int64), ("length", np.int64))]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = [*out.columns, *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
            return pa.Table.from_arrays(columns, names=names).filter(pa.array(hit))

        return asked.groupBy("bucket").cogroup(index.drop("shelf").groupBy("bucket")).applyInArrow(
            found, "doc_id long, nth int, part int, block int, offset long, length long"
        )

    def payloads(self, digest=None, kind: str = "binary") -> DataFrame:
        """(part, block, offset, length, payload) read from the raw ids; ``digest`` maps a document's bytes to what is returned."""
        arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]
        digest = digest or bytes

        @tn.tidied
        def read(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    raw, length = row["ids"], np.array(row["lengths"], np.int64)
                    ends = np.cumsum(length)
                    offset = ends - length
                    got = [digest(raw[4 * a : 4 * b]) for a, b in zip(offset.tolist(), ends.tolist(), strict=True)]
                    n = len(length)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, row["part"], np.int32)),
                            pa.array(np.full(n, row["block"], np.int32)),
                            pa.array(offset),
                            pa.array(length),
                            pa.array(got, arrow),
                        ],
                        names=["part", "block", "offset", "length", "payload"],
                    )

        few = self.blocks().select("part", "block", "lengths", "ids")
        return few.mapInArrow(read, f"part int, block int, offset long, length long, payload {kind}")

    def starts(self) -> DataFrame:
        """(part, block, before): the ids in all blocks before."""
        sizes = self.blocks().select("part", "block", "n_tokens")
        parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
        parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("parts_before"))
        inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
            "part", "block", (F.col("own") + F.col("parts_before")).alias("before")
        )


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> TokenFiles:
    """Writes the ids of all rows of ``docs`` (doc_id, text) and their index.

    A null text is encoded as an empty one: its only id is END. Null ids come
    first; rows that share an id are ordered by text and numbered from 0, so that
    each has a key. Other columns are not read. An empty table gives empty files.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/leafspan/tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(8, total_bytes(docs) // PART_BYTES + 1)
    ranged = docs.repartitionByRange(int(parts), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    blocks = ranged.mapInArrow(_writer(tokenizer or tokenizer_path()), IDS.partition(", ")[2])
    with unsorted_writes(spark):
        _shelved(blocks, "part", PARTS_OF_SHELF).write.option("compression", "zstd").partitionBy("shelf").parquet(f"{path}/ids")
    files = TokenFiles(spark, path)
    total = files.blocks().agg(F.sum(F.size("lengths"))).first()[0] or 0
    buckets = max(1, int(total) // BUCKET_KEYS)
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/size")

    @tn.tidied
    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, length = len(row["lengths"]), np.array(row["lengths"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["nths"], pa.int32()),
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["block"], np.int32)),
                        pa.array(np.cumsum(length) - length),
                        pa.array(length),
                    ],
                    names=["doc_id", "nth", "part", "block", "offset", "length"],
                )

    rows = files.blocks().select("part", "block", "doc_ids", "nths", "lengths").mapInArrow(
        listed, "doc_id long, nth int, part int, block int, offset long, length long"
    )
    index = rows.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_indexed, INDEX.partition(", ")[2])
    with unsorted_writes(spark):
        _shelved(index, "bucket", BUCKETS_OF_SHELF).repartition("shelf").write.partitionBy("shelf").parquet(f"{path}/index")
    return files


def _shelved(rows: DataFrame, column: str, many: int) -> DataFrame:
    return rows.withColumn("shelf", F.floor(F.col(column) / many).cast("int"))


def read_back(files: TokenFiles, docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``docs``, found through the index and read from the raw ids."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    starts = counted.withColumn("low", F.explode(F.expr("sequence(0, n - 1, 65536)")))  # an id may have very many rows
    keys = starts.select("doc_id", F.explode(F.sequence("low", F.least(F.col("low") + 65535, F.col("n") - 1))).alias("nth"))
    read = files.payloads(zlib.crc32, "long").withColumnRenamed("payload", "ids_crc32")
    return (
        files.lookup(keys)
        .join(read, ["part", "block", "offset", "length"])
        .join(files.starts(), ["part", "block"])
        .select("doc_id", (F.col("before") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")
    )
