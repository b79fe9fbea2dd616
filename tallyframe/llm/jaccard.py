"""N-gram Jaccard join by a token-group matrix.

Texts of the same words are one class. A class's shingles are ordered by hash; any two classes that are similar enough
share a known number of their first shingles, so postings of those alone, exchanged in blocks, give all pairs that can
be similar, with an upper bound of what they share. Pairs whose bound is too low go. What is left falls into small
families. Within a family, similar classes form groups, the matrix holds each group's union of shingles, a class's
overlap with the union bounds its overlap with every member, and only groups that can hold a similar one are opened.
Shingles in more than MOST_PAIRED classes aren't paired: a class whose first shingles are mostly of that kind joins the
family of the others that have them, which is exact again as families are searched whole. A family of more than
MOST_IN_TASK classes is cut into blocks, and every two of its blocks are searched together, each pair of blocks in a
task of its own; what they link is joined after.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, empty_text, table, written
from .components import components
from .shingles import hashed_words, shingle_hashes

SIZE, PERCENT = 5, 80
#: Classes that a first shingle may have for its pairs to be listed.
MOST_PAIRED = 48
#: Members a group may have; classes that a task searches, about.
MOST_IN_GROUP, MOST_IN_TASK = 128, 8192
_ROW = "kind int, a long, b long, na int, nb int, c int, doc_id {id}"


def first_shingles(n: int, percent: int = PERCENT) -> int:
    """So many of its first shingles a class of n posts: similar ones share more than n // 10 of them."""
    least = -(-n * percent // 100)
    return min(n, n - least + 1 + n // 10)


def _classes(texts: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Place, class and distinct shingles, by hash, of each text."""
    for k, words, hashes in hashed_words(texts):
        key = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
        yield k, key, np.unique(shingle_hashes(hashes, size))


def _post(buckets: int, size: int, percent: int):
    """Batches of documents to profile rows (bucket below 0) and blocks of postings, one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [x.as_py().lower() for x in batch.column(1)]
                keys, ns, firsts, seen = [], [], [], set()
                for _, key, h in _classes(texts, size):
                    keys.append(key)
                    ns.append(len(h))
                    firsts.append(h[: first_shingles(len(h), percent)] if key not in seen else h[:0])
                    seen.add(key)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys) % buckets - buckets, pa.int64()), batch.column(0), pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), batch.column(2), pa.nulls(n, pa.binary())], names)
                token = np.concatenate(firsts) if n else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(n), [len(f) for f in firsts])
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, token, owner = bucket[order], token[order], owner[order]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cut[1:], len(bucket))[: len(cut)]
                blocks = [_packed(np.array(keys), np.array(ns), token[s:e], owner[s:e]) for s, e in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.nulls(len(cut), batch.schema.types[0]), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.int64()), pa.array(blocks, pa.binary())], names)

    names = ["bucket", "doc_id", "key", "n", "bytes", "block"]
    return run


def _packed(keys: np.ndarray, ns: np.ndarray, token: np.ndarray, owner: np.ndarray) -> bytes:
    """Postings by class: classes, their sizes, how many each has, then 6 bytes of each shingle."""
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[cut]
    short = (token >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join((len(cut).to_bytes(4, "little"), keys[who].astype("<i8").tobytes(), ns[who].astype("<i4").tobytes(), np.diff(np.append(cut, len(owner))).astype("<i4").tobytes(), short.tobytes()))


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(block[:4], "little")
    keys = np.frombuffer(block, "<i8", k, 4)
    ns = np.frombuffer(block, "<i4", k, 4 + 8 * k)
    many = np.frombuffer(block, "<i4", k, 4 + 12 * k)
    short = np.frombuffer(block, np.uint8, -1, 4 + 16 * k).reshape(-1, 6)
    token = np.zeros((len(short), 8), np.uint8)
    token[:, :6] = short
    return keys, ns, many, token.view("<u8").ravel()


def _pair(names: list[str], id_type: pa.DataType, percent: int):
    """The blocks of a bucket to pairs (kind 1); profiles pass (kind 0: class, hash of the text's bytes, shingles).

    Of shingles that too many classes share: each class, the first of those that share one, and how many (kind 2).
    """

    def rows(kind: int, a, b, na, nb, c) -> pa.Table:
        n = len(a)
        whole = lambda x: pa.array(x, pa.int32())
        return pa.Table.from_arrays([whole(np.full(n, kind)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), whole(na), whole(nb), whole(c), pa.nulls(n, id_type)], names)

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            n = blocks.num_rows
            none = pa.nulls(n, pa.int32())
            return pa.Table.from_arrays([pa.array(np.zeros(n, np.int32)), blocks["key"], blocks["bytes"], blocks["n"], none, none, blocks["doc_id"]], names)
        parts = [_unpacked(x.as_py()) for x in blocks["block"]]
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.zeros(len(keys), np.int64)
        sizes[where] = np.concatenate([p[1] for p in parts])
        owner = np.repeat(where, np.concatenate([p[2] for p in parts]))
        token = np.concatenate([p[3] for p in parts])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
        token, owner = token[fresh], owner[fresh]
        cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        many = np.diff(np.append(cut, len(token)))
        found: list[np.ndarray] = []
        for m in np.unique(many[(many > 1) & (many <= MOST_PAIRED)]):
            members = owner[cut[many == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            found.append((members[:, i] * len(keys) + members[:, j]).ravel())
        pairs, often = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        a, b = np.divmod(pairs, len(keys))
        able = np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * percent
        a, b, often = a[able], b[able], often[able]
        out = [rows(1, keys[a], keys[b], sizes[a], sizes[b], often)]
        hot = np.repeat(many > MOST_PAIRED, many)
        first = np.repeat(owner[cut], many)[hot]
        held, often = np.unique(owner[hot] * len(keys) + first, return_counts=True)
        who, first = np.divmod(held, len(keys))
        out.append(rows(2, keys[who], keys[first], sizes[who], sizes[first], often))
        return pa.concat_tables(out)

    return run


def families(posted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, root: classes that may be similar to another, and the family that holds all that may be similar to it."""
    hot = posted.where("kind = 2")
    hots = hot.groupBy("a").agg(F.sum("c").alias("h"), F.first("na").alias("n"))
    first = lambda n: F.least(n, n - F.ceil(n * percent / F.lit(100)) + 1 + F.floor(n / 10))
    rest = lambda n: n - first(n)
    pairs = posted.where("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    of = lambda c: hots.select(F.col("a").alias(c), F.col("h").alias(f"h{c}"))
    least = F.ceil(F.col("percent") * (F.col("na") + F.col("nb")) / (100 + F.col("percent")))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("percent", F.lit(percent))
    unseen = F.greatest(rest(F.col("na")), rest(F.col("nb"))) + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = pairs.where(F.col("c") + unseen >= least).select("a", "b")
    bound = hots.where(F.col("h") > F.floor(F.col("n") / 10)).select("a")
    star = hot.join(bound, "a").where(F.col("a") != F.col("b")).select("a", "b")
    return components(pairs.union(star))


class _Sets:
    """Union of what links have joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def joined(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the first of those that links reach, exactly, by the token-group matrix."""
    flat = np.concatenate(sets)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    cut = np.cumsum([len(s) for s in sets])[:-1]
    rows = [np.sort(r) for r in np.split(rank[token], cut)]
    rare = int((often == 1).sum())  # these can't be shared
    done = _Sets(len(rows))
    unions: list[set[int]] = []
    members: list[list[int]] = []
    full: list[frozenset[int]] = [frozenset()] * len(rows)
    matrix: dict[int, list[int]] = defaultdict(list)
    for q in sorted(range(len(rows)), key=lambda k: len(rows[k])):
        row, n = rows[q], len(rows[q])
        if not n:
            continue
        least = -(-n * percent // 100)
        head = row[: n - least + 1]
        head = head[head >= rare].tolist()
        full[q] = own = frozenset(row.tolist())
        best, most = -1, 0
        for g in sorted(set(g for t in head for g in matrix[t])):
            if all(done.root(m) == done.root(q) for m in members[g][:1]) and len({done.root(m) for m in members[g]}) == 1:
                continue
            if len(own & unions[g]) < least:
                continue
            for m in members[g]:
                if done.root(m) == done.root(q):
                    continue
                both = len(own & full[m])
                if 100 * both >= percent * (n + len(full[m]) - both):
                    done.join(q, m)
                    if both > most and len(members[g]) < MOST_IN_GROUP:
                        best, most = g, both
        if best < 0:
            best = len(unions)
            unions.append(set())
            members.append([])
        unions[best] |= own
        members[best].append(q)
        for t in head:
            if not matrix[t] or matrix[t][-1] != best:
                matrix[t].append(best)
    return [done.root(k) for k in range(len(rows))]


def _solve(size: int, percent: int):
    """The texts of a task to a link from each class to the first one of those that it reaches there."""

    def run(key: tuple, family: pa.Table) -> pa.Table:
        texts, asked = family["text"].to_pylist(), family["key"].to_pylist()
        found: dict[int, np.ndarray] = {}
        for k, cls, h in _classes([x.lower() for x in texts], size):
            if cls == asked[k]:
                found.setdefault(cls, h)
        classes = np.array(sorted(found), np.int64)
        roots = joined([found[c] for c in classes.tolist()], percent) if len(classes) else []
        whole = pa.array(np.full(len(classes), key[1].as_py() == 0), pa.bool_())
        return pa.Table.from_arrays([pa.array(classes), pa.array(classes[roots] if len(classes) else classes), whole], ["a", "b", "whole"])

    return run


def _tasks(asked: DataFrame) -> DataFrame:
    """asked with a row for each task of a class: its family, and which blocks, 0 and 0 for a family in one."""
    sizes = asked.groupBy("root").agg(F.ceil(F.count("*") * 2 / MOST_IN_TASK).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.col("other")
    rows = asked.join(sizes, "root").withColumn("own", F.when(F.col("blocks") <= 2, 0).otherwise(own))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    number = F.when(F.col("blocks") <= 2, 0).otherwise(1 + F.least("own", other) * F.col("blocks") + F.greatest("own", other))
    return rows.withColumn("task", number).select("key", F.col("first").alias("id"), F.col("bytes").alias("id_bytes"), "root", "task")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as UTF-8 and a hash of these bytes: with the doc_id it tells rows apart, where doc_ids are null or repeated, too."""
    return docs.select("doc_id", F.encode(empty_text(), "UTF-8").alias("text"), F.xxhash64(empty_text()).alias("bytes"))


def _linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, bytes, key (class) and n of each row, and key, root of each class that links with others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    buckets = cells(docs)
    texts = _texts(docs)
    schema = _ROW.format(id=kind)
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = texts.mapInArrow(_post(buckets, size, percent), f"bucket long, doc_id {kind}, key long, n int, bytes long, block binary")
    posted = written(blocks.groupBy("bucket").applyInArrow(_pair(names, id_type, percent), schema), "jaccard-posted")
    profile = posted.where("kind = 0").select("doc_id", F.col("b").alias("bytes"), F.col("a").alias("key"), F.col("na").alias("n"))
    roots = families(posted, percent).select(F.col("node").alias("key"), "root")
    asked = written(_firsts(profile, "key").join(roots, "key"), "jaccard-families")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("bytes") == F.col("id_bytes"))
    near = texts.join(_tasks(asked).hint("merge"), same).select("root", "task", "key", "text").dropDuplicates(["root", "task", "key"])
    links = written(near.groupBy("root", "task").applyInArrow(_solve(size, percent), "a long, b long, whole boolean"), "jaccard-links")
    apart = components(links.where("not whole").select("a", "b"))
    return profile, links.where("whole").select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(apart.select(F.col("node").alias("key"), "root"))


def _firsts(profile: DataFrame, by: str) -> DataFrame:
    """by, first, bytes: of each class or root the least doc_id, a null one last, and which of its texts."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "bytes")).alias("f")
    return profile.where("n > 0").groupBy(by).agg(first).select(by, F.col("f.doc_id").alias("first"), F.col("f.bytes").alias("bytes"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and text_class of each row of docs.

    component_id: the least doc_id that links reach. Null, empty and blank texts have no shingles, link with nothing
    and keep their own doc_id. Rows of equal words are linked, repeated rows too. A null doc_id is in a component
    like others, but isn't its least while any other is there. Other columns are ignored. Empty table: no rows.
    """
    profile, found = _linked(docs, size, percent)
    first = _firsts(profile, "key").drop("bytes")
    linked = first.join(found, "key")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    known = first.join(linked.join(least, "root").select("key", "least"), "key", "left").select("key", F.coalesce("least", "first").alias("component"))
    return profile.join(known, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.col("key").alias("text_class")
    )


def deduplicated(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least doc_id, and of its least text.

    Rows are told apart by doc_id and text, so where a doc_id is null or has several texts, each text is a document of
    its own; of rows equal in both, one stays. A null doc_id is later than all others. Null, empty and blank texts are
    in no component: all their rows stay.
    """
    profile, found = _linked(docs, size, percent)
    rows = profile.where("n > 0").groupBy("doc_id", "bytes", "key").agg(F.first("n").alias("n"), F.count("*").alias("times"))
    rows = rows.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = _firsts(rows, "root").select(F.col("root").alias("its root"), F.col("first").alias("stays"), F.col("bytes").alias("stays_bytes"))
    stays = F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("bytes") == F.col("stays_bytes"))
    marked = rows.join(least, F.col("root") == F.col("its root")).select(F.col("doc_id").alias("marked id"), F.col("bytes").alias("marked bytes"), stays.alias("stays"), "times")
    marked = written(marked.where(~F.col("stays") | (F.col("times") > 1)), "jaccard-marked")

    named = docs.toDF(*[f"carried {k}" for k in range(len(docs.columns))])
    column = {c: F.col(f"carried {k}") for k, c in enumerate(docs.columns)}
    same = column["doc_id"].eqNullSafe(F.col("marked id")) & (F.xxhash64(F.coalesce(column["text"], F.lit(""))) == F.col("marked bytes"))
    out = named.join(marked, same, "left_anti")
    repeated = marked.where("stays").drop("stays", "times")
    if not repeated.isEmpty():
        again = named.join(repeated, same)
        out = out.unionByName(again.dropDuplicates(["marked id", "marked bytes"]).drop("marked id", "marked bytes"))
    return out.toDF(*docs.columns)


def op9_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("text_class")
