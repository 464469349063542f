"""Duplicates hidden by formatting: one record per canonical form, with its copies.

Canonical bytes keep letters, digits and combining marks in their order, case
folded, of the text (its named fields in fixed order, each closed by a mark
that no text holds) and the section number. Equal bytes, equal record.

1. Every input partition makes the bytes, a batch at a time, and folds its own
   copies in a local trie, so of a hot group each partition sends one entry.
2. Radix partitioning of the entries: a prefix bucket over ``bucket_bytes`` is
   split by further bytes (the prefix doubles) until each fits or holds one key.
3. Burst tries with terminal counters count each bucket's keys; they give the
   kept id of every local representative, which is joined back by id alone.

Defined results: a null section number is an empty one; texts without letters
or digits (null, empty, blank) are no record; repeated record ids are one row;
the least id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import written

FIELDS = ("Act", "Section", "State", "Status", "Text")
#: Fixed values of the problem: what is neither compared nor part of a word.
_DROP = r"[^\p{L}\p{Nd}\p{M}]+"
_APART = r"[^\p{L}\p{N}\p{M}]"
_MARK, _END = "\u0001", "\u0000"


def plain(a: pa.Array) -> pa.Array:
    """Letters, digits and combining marks of strings, case ignored."""
    return pc.utf8_lower(pc.utf8_upper(pc.replace_substring_regex(a, _DROP, "")))


def canonical_texts(texts: pa.Array, fields: tuple[str, ...] = FIELDS) -> pa.Array:
    """Canonical strings of texts; of a text of named fields, each field's, in fixed order."""
    texts = pc.fill_null(texts, "")
    # each test sees only what the one before left
    at = pc.indices_nonzero(pc.match_substring(texts, ":"))
    for f in fields:
        at = at.filter(pc.match_substring_regex(texts.take(at), rf"(?i)(?:^|{_APART}){f}\s*:"))
    out = plain(texts)
    if not len(at):
        return out
    named, every = texts.take(at), "|".join(fields)
    # the names may stand in any order, so each is sought on its own
    parts = [plain(pc.struct_field(pc.extract_regex(named, rf"(?is)(?:^|{_APART}){f}\s*:(?:(?:{every})\s*:|(?P<v>.*?)(?:{_APART}(?:{every})\s*:|$))"), 0)) for f in fields]
    joined = pc.binary_join_element_wise(*parts, "", _MARK)
    mask = np.zeros(len(texts), bool)
    mask[at.to_numpy()] = True
    return pc.replace_with_mask(out, pa.array(mask), joined)


def canonical(texts: pa.Array, sections: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(bytes compared, whether the text has a letter or digit)."""
    t = canonical_texts(texts)
    return pc.binary_join_element_wise(t, plain(pc.fill_null(sections, "")), _END).cast(pa.large_binary()), pc.match_substring_regex(t, r"[\p{L}\p{Nd}]")


class BurstTrie:
    """Byte trie whose leaves are tables of suffixes; a leaf over *burst* keys splits by its next byte. Terminals hold [least id, count]."""

    __slots__ = ("root", "burst")

    def __init__(self, burst: int = 8192):
        self.root: list = [{}, None, None]  # table of suffixes, children by byte, terminal of the empty suffix
        self.burst = burst

    def add(self, key: bytes, least: int, count: int = 1) -> list:
        node, at = self.root, 0
        while node[1] is not None:
            if at == len(key):
                if node[2] is None:
                    node[2] = [least, 0]
                t = node[2]
                break
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [{}, None, None]
            node, at = child, at + 1
        else:
            table, rest = node[0], key[at:]
            t = table.get(rest)
            if t is None:
                t = table[rest] = [least, 0]
                if len(table) > self.burst:
                    self._split(node)
        if least < t[0]:
            t[0] = least
        t[1] += count
        return t

    @staticmethod
    def _split(node: list) -> None:
        table, node[0], node[1] = node[0], None, {}
        for rest, t in table.items():
            if not rest:
                node[2] = t
                continue
            child = node[1].get(rest[0])
            if child is None:
                child = node[1][rest[0]] = [{}, None, None]
            child[0][rest[1:]] = t


_LOCAL = pa.schema([("record_id", pa.int64()), ("local", pa.int64()), ("canon", pa.binary()), ("n", pa.int64())])


def _local(flush_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, rows = BurstTrie(), 0, []

        def flush() -> pa.RecordBatch:
            ids, local, canon, n, done = [], [], [], [], set()
            for i, key, t in rows:
                first = i == t[0] and i not in done
                if first:
                    done.add(i)
                ids.append(i)
                local.append(t[0])
                canon.append(key if first else None)
                n.append(t[1] if first else 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(local, pa.int64()), pa.array(canon, pa.binary()), pa.array(n, pa.int64())], schema=_LOCAL)

        for b in batches:
            keys, any_text = canonical(b.column(1), b.column(2))
            for i, key in zip(b.column(0).filter(any_text).to_pylist(), keys.filter(any_text).to_pylist()):
                t = trie.add(key, i)
                rows.append((i, key, t))
                held += len(key) + 60
                if held > flush_bytes:
                    yield flush()
                    trie, held, rows = BurstTrie(), 0, []
        if rows:
            yield flush()

    return run


_KEPT = pa.schema([("local", pa.int64()), ("kept", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, so one bucket's trie is held at a time."""
    now, trie, own = None, BurstTrie(), []

    def flush(own: list) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 50000):
            part = own[k : k + 50000]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in part], pa.int64()), pa.array([t[0] for _, t in part], pa.int64()),
                pa.array([t[1] if i == t[0] else 0 for i, t in part], pa.int64()),
            ], schema=_KEPT)

    closed: list[tuple[int, list]] = []
    for b in batches:
        for bucket, rest, i, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            if bucket != now:
                closed += own
                now, trie, own = bucket, BurstTrie(), []
                if len(closed) >= 50000:
                    yield from flush(closed)
                    closed = []
            own.append((i, trie.add(rest, i, n)))
    yield from flush(closed + own)


def marked(entries: DataFrame, prefixes: DataFrame, w: int, name: str, how: str, limit: int = 32 << 20, salts: int = 32) -> DataFrame:
    """Join of entries with prefixes of *w* bytes: by broadcast if these are small, else salted, as one prefix may hold a third of all entries."""
    p = F.substring("canon", 1, w)
    if prefixes.count() * (w + 64) <= limit:
        return entries.join(F.broadcast(prefixes), p == F.col(name), how)
    spread = prefixes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return entries.withColumn("__s", F.pmod("local", F.lit(salts))).join(spread, (p == F.col(name)) & (F.col("__s") == F.col("__salt")), how).drop("__salt", "__s")


def radix_bucket(entries: DataFrame, bucket_bytes: int, first_width: int = 4, last_width: int = 1 << 20) -> DataFrame:
    """entries with ``width``: the length of the shortest prefix of canon whose bucket fits or holds one key."""
    out, width, w, marks = entries, F.lit(first_width), first_width, []
    open_rows = entries.select("local", "canon")
    while w <= last_width:
        # one key has one hash and one length; two keys taken for one only stay together in a bucket
        kind = F.struct(F.length("canon"), F.xxhash64("canon"))
        big = (
            open_rows.groupBy(F.substring("canon", 1, w).alias(f"p{w}")).agg(F.sum(F.length("canon") + 64).alias("b"), F.min(kind).alias("lo"), F.max(kind).alias("hi"))
            .where((F.col("b") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select(f"p{w}")
        )
        big = written(big, "p6-oversized")
        if big.isEmpty():
            break
        # rows that end before the wider prefix are told apart by their length alone
        open_rows = marked(open_rows, big, w, f"p{w}", "left_semi")
        out = marked(out, big, w, f"p{w}", "left")
        width = F.when(F.col(f"p{w}").isNotNull(), F.lit(2 * w)).otherwise(width)
        marks.append(f"p{w}")
        w *= 2
    return out.withColumn("width", width).drop(*marks)


def collapse(df: DataFrame, key: str = "record_id", section: str = "section_number", text: str = "text",
             bucket_bytes: int = 16 << 20, flush_bytes: int = 24 << 20) -> tuple[DataFrame, DataFrame]:
    """(records, copies): records(kept_id, n_copies) one row per record; copies(kept_id, copy_id) one row per further copy."""
    rows = df.select(F.col(key).cast("long").alias("record_id"), F.col(text).cast("string").alias("t"), F.col(section).cast("string").alias("s")).where("record_id is not null")
    local = written(rows.mapInArrow(_local(flush_bytes), "record_id long, local long, canon binary, n long"), "p6-local")
    entries = local.where("canon is not null")
    cut = radix_bucket(entries, bucket_bytes).select(
        F.substring("canon", F.lit(1), F.col("width")).alias("bucket"), F.expr("substring(canon, width + 1)").alias("rest"), "local", "n",
    )
    # a task may get any number of buckets, but works on one at a time
    kept = cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "local long, kept long, n long")
    kept = written(kept, "p6-kept")
    records = kept.where("local = kept").groupBy(F.col("kept").alias("kept_id")).agg(F.max("n").alias("n_copies"))
    moved = kept.where("local <> kept").select("local", "kept").distinct()
    own = local.where("record_id <> local").select("record_id", "local")
    copies = own.join(moved, "local", "left").select(F.coalesce("kept", "local").alias("kept_id"), F.col("record_id").alias("copy_id")).union(
        moved.select("kept", "local")
    )
    return records, copies
