"""Operators on documents, against brute force on a small table with odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bwt, jaccard, mixing, packing, quality, sharding, suffixes, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# ---- sharding ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("step", [12, 3])
def test_shards_have_the_least_capacity(docs, texts, step):
    rows = sharding.shard(docs, 4, step).collect()
    assert len(rows) == len(texts) + 2
    sizes, atoms = Counter(), Counter()
    shard_of = defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        sizes[r["shard"]] += r["size"]
        atoms[r["place"]] += r["size"]
        shard_of[t].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    for k in set(sizes):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))

    def shards(capacity):
        used, held = 1, 0
        for _, n in sorted(atoms.items()):
            if n > capacity:
                return 99
            used, held = (used + 1, n) if held + n > capacity else (used, held + n)
        return used

    capacity = rows[0]["capacity"]
    assert max(sizes.values()) <= capacity and shards(capacity) <= 4 < shards(capacity - 1)


# ---- quality -------------------------------------------------------------------------------------------------------


def slow_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(triples)
    covered = {k + j for k, t in enumerate(triples) if often[t] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(texts):
    for t in [*texts, "a b c a b c a", "x\nx\n\n \n\nx", "# * a$%&|<>", "a\x1cb \x85c d"]:
        assert quality.counts(t) == slow_counts(t), t


def test_verdicts(spark, docs, texts):
    rows = by_id(quality.judge(docs))
    assert sum(map(len, rows.values())) == len(texts) + 2
    for k, own in rows.items():
        n = slow_counts(texts[k])
        for r in own:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r["base_failed"] and r["kept"])
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k for k, own in rows.items() for r in own if r["kept"])


def test_fences_follow_their_group(spark):
    import random

    dice = random.Random(1)
    text = lambda symbols: " ".join(f"w{dice.randrange(9999)}" + ("#" if dice.random() < symbols else "") for _ in range(100))
    rows = [(k, text(0.0), "en", "clean") for k in range(150)] + [(150 + k, text(0.3), "en", "tags") for k in range(150)] + [(300, text(0.9), "en", "clean"), (301, text(0.3), "en", "clean"), (302, text(0.3), "en", "tags")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(300)) and not got[300] and not got[301] and got[302]


def test_repeated_words_follow_their_group(spark):
    import random

    dice = random.Random(5)
    clean = lambda n: " ".join(f"w{dice.randrange(10**9)}" for _ in range(n))
    rows = [(k, clean(100), "en", "s") for k in range(150)] + [(150, clean(56) + " w111111111 w222222222 w333333333 w444444444" * 11, "en", "s")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[150]["n_repeat_words"] == 44 and not got[150]["base_failed"] and not got[150]["kept"]
    assert all(got[k]["kept"] for k in range(150))


# ---- packing -------------------------------------------------------------------------------------------------------


def test_best_fit_over_counts_is_best_fit():
    import random

    dice = random.Random(2)
    for _ in range(30):
        limit = dice.choice([10, 64])
        lengths = [dice.randint(1, limit) for _ in range(dice.randint(1, 300))]
        free = []
        for n in sorted(lengths, reverse=True):
            able = [(f, k) for k, f in enumerate(free) if f >= n]
            k = min(able)[1] if able else len(free)
            if not able:
                free.append(limit)
            free[k] -= n
        plan = packing.best_fit(dict(Counter(lengths)), limit)
        held, seen = defaultdict(list), Counter()
        for length, rank, n, first, offset in plan:
            seen[length] += n
            for j in range(n):
                held[first + j].append((offset, length))
        assert seen == Counter(lengths) and len(held) == len(free)
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= limit


def test_packing(docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs, path, limit=256, ids=True).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
    for k, own in parts.items():
        ids = tok.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        copies = 3 if k == 3 else 1
        want = [(p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(want * copies)
        assert all(r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in own)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        assert sorted(own) == [(sum(n for _, n in sorted(own)[:k]), n) for k, (_, n) in enumerate(sorted(own))] and sum(n for _, n in own) <= 256
    assert len(held) <= -(-sum(r["length"] for r in rows) // 256) + 2


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == [187.5, 75.0, 37.5]
    assert mixing.targets([("a", 10), ("b", 1000)]) == [30.0, 980.0]
    assert mixing.targets([("a", 0), ("b", 8)]) == [0.0, 8.0]
    assert mixing.targets([("a", 0)]) == [0.0] and mixing.targets([]) == []


def test_tree_keeps_sums():
    quotas = [100, 7, 0, 33]
    split = mixing.tree(quotas, 8, 1)
    assert split.sum(0).tolist() == quotas and split.sum(1).max() - split.sum(1).min() <= 3
    assert (mixing.tree(quotas, 8, 1) == split).all() and split.min() >= 0


def test_mix(docs, texts):
    rows = mixing.mix(docs, shards=4, block_words=50).collect()
    assert len(rows) == len(texts) + 2
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(d["words"] for d in r["draws"]) and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    assert [goal[s] for s in order] == mixing.targets([(s, sizes[s]) for s in order])
    for s in order:
        assert taken[s] == min(3 * sizes[s], round(goal[s]))
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5), shards=4, block_words=50).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixed_rows(docs):
    drawn = mixing.mixed(docs.dropDuplicates(["doc_id"]))
    taken = {r["doc_id"]: r for r in mixing.mix(docs.dropDuplicates(["doc_id"])).collect()}
    assert drawn.columns == docs.columns
    got = Counter()
    for r in drawn.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({k: r["taken"] for k, r in taken.items() if r["taken"]})


def test_cut_documents_keep_their_lines(spark):
    text = "\n".join(f"a{k}  b{k}\tc" for k in range(400))
    rows = spark.createDataFrame([(k, text, "en", s, len(text)) for k, s in enumerate("abc")], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in mixing.mixed(rows).collect()]
    assert all(text.startswith(t) for t in got) and any(t != text for t in got)


# ---- Jaccard join --------------------------------------------------------------------------------------------------


def slow_components(rows, size=5):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(set() if not w else {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(d, least.get(root(k), d))
    return {d: (len(sets[k]), least[root(k)]) for k, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("paired", "task"), [(48, 8192), (2, 8192), (48, 4), (2, 2)])
def test_links(docs, texts, paired, task, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_PAIRED", paired)
    monkeypatch.setattr(jaccard, "MOST_IN_TASK", task)
    got = by_id(jaccard.join(docs))
    want = slow_components(list(enumerate(texts)))
    assert {k: {(r["n_shingles"], r["component_id"]) for r in v} for k, v in got.items()} == {k: {v} for k, v in want.items()}
    assert len(got[3]) == 3
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c}


def test_matrix_is_exact():
    dice = np.random.Generator(np.random.PCG64(4))
    for _ in range(40):
        base = [dice.choice(200, dice.integers(1, 40), replace=False) for _ in range(6)]
        sets = []
        for _ in range(30):
            own = set(base[dice.integers(6)].tolist())
            for _ in range(dice.integers(0, 4)):
                own ^= {int(dice.integers(200))}
            sets.append(np.array(sorted(own), np.uint64))
        got = jaccard.joined(sets)
        up = list(range(len(sets)))
        for _ in sets:  # to a fixed point
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    both = len(np.intersect1d(a, b))
                    if both and 100 * both >= 80 * (len(a) + len(b) - both):
                        up[i] = up[j] = min(up[i], up[j])
        assert [[got[i] == got[j] for i in range(30)] for j in range(30)] == [[up[i] == up[j] for i in range(30)] for j in range(30)]


def test_null_doc_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (5, "a b c d e f"), (None, "other words in here now")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 5), (None, 5), (5, 5), (None, None)], key=repr)


def test_only_rows_of_a_linked_text_go(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (None, "words that nobody else has here"), (7, "a B c d e f"), (7, "more words that only this row has"), (None, "two rows without any id at all"), (None, "two rows without any id at all")]
    got = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)


# ---- suffix dedup --------------------------------------------------------------------------------------------------


def slow_removed(rows, least=50):
    first, out = {}, {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(d, first.get(w, d))
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < d:
                gone[k : k + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("slice_", [1 << 20, 64])
def test_suffix_dedup(docs, texts, slice_, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    got = by_id(suffixes.dedup(docs))
    want = slow_removed(list(enumerate(texts)))
    assert {k: {(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in v} for k, v in got.items()} == {k: {v} for k, v in want.items()}
    assert len(got[3]) == 3
    for k, v in got.items():
        raw = (texts[k] or "").encode()
        for s in reversed(v[0]["spans"]):
            raw = raw[: s["start"]] + raw[s["end"] :]
        assert raw == v[0]["kept"]


def test_suffix_dedup_of_null_ids(spark):
    t = "abcdefghij" * 6
    rows = [(None, t), (None, t + "!"), (4, t)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(4, 0), (None, 60), (None, 60)], key=repr)


def test_transform_finds_shared_prefixes():
    dice = np.random.Generator(np.random.PCG64(6))
    for _ in range(60):
        rows, width, least = int(dice.integers(1, 12)), 30, int(dice.integers(1, 9))
        start = dice.integers(0, 6, rows)
        end = np.minimum(width - 1, start + dice.integers(0, 24, rows))
        symbols = np.zeros((rows, width), np.uint16)
        for k in range(rows):
            symbols[k, start[k] : end[k]] = dice.integers(1, 3, end[k] - start[k])
        r, c, kind = bwt.shared(symbols, start, end, least)
        got = defaultdict(set)
        for a, b, g in zip(r.tolist(), c.tolist(), kind.tolist(), strict=True):
            got[g].add((a, b))
        want = defaultdict(set)
        for k in range(rows):
            for j in range(start[k], end[k] - least + 1):
                want[tuple(symbols[k, j : j + least])].add((k, j))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- compact windows -----------------------------------------------------------------------------------------------


def test_tree_nodes_are_the_minima_of_all_long_ranges():
    dice = np.random.Generator(np.random.PCG64(8))
    for _ in range(60):
        n, least = int(dice.integers(1, 60)), int(dice.integers(1, 9))
        values = dice.integers(0, 1 << 63, n, dtype=np.uint64)
        if dice.random() < 0.5:
            values = values[dice.integers(0, max(1, n // 4), n)]
        low, at, high, _ = windows.tree_nodes(values, np.array([0]), np.array([n]), least)
        for s in range(n - least + 1):
            for e in range(s + least - 1, n):
                own = [(a, m, b) for a, m, b in zip(low, at, high, strict=True) if a <= s and e <= b and s <= m <= e]
                assert own and all(values[m] >> np.uint64(28) == values[s : e + 1].min() >> np.uint64(28) for _, m, _ in own)


def _slow_alike(mine, other, span, percent):
    """Matches of `mine` that an interval of at least `span` places holds which is similar enough to one of `other`."""
    out = set()
    for c in range(len(other)):
        for d in range(c + 1, len(other) + 1):
            peer = set(other[c:d])
            for a in range(len(mine)):
                for b in range(a + span, len(mine) + 1):
                    own = set(mine[a:b])
                    if 100 * len(own & peer) >= percent * len(own | peer):
                        out |= {k for k in range(a, b) if mine[k] in peer}
    return out


def _found(mine, other, span, percent=80):
    mine, other = np.array(mine, np.uint64), np.array(other, np.uint64)
    out = windows.passages(mine, windows._Other(other), span, percent)
    assert all(b - a >= span and s >= percent / 100 for a, b, s in out)
    return {k for a, b, _ in out for k in range(a, b)}


def test_passages_with_edits_at_ends_and_in_clusters():
    dice = np.random.Generator(np.random.PCG64(9))
    for _ in range(25):
        base = list(range(100, 116 + int(dice.integers(0, 4))))
        edited = list(base)
        for k in range(int(dice.integers(0, 5))):
            at = int(dice.integers(0, len(edited)))
            edited[at : at + int(dice.integers(0, 2))] = [500 + k] * int(dice.integers(0, 2))
        other = [*range(900, 902), *edited, 910]
        assert _found(base, other, 8) >= _slow_alike(base, other, 8, 80)
    mine = list(range(1, 97))
    # the second word of 50 differs: 44 of 48 shingles
    assert len(_found(mine[:46], [201, 202, *mine[2:46]], 46)) == 46
    # a change every 10 words over the first half, two in the second: only the second is similar enough
    other = [x if k % 10 > 4 else 1000 + x for k, x in enumerate(range(1, 101))] + [x if (k - 33) % 34 > 4 else 1000 + x for k, x in enumerate(range(101, 201))]
    got = _found(list(range(1, 201)), other, 46)
    assert {k for k in range(100, 200) if other[k] == k + 1} <= got


def test_passages_are_cut_from_later_documents(docs, texts):
    got = by_id(windows.dedup(docs))
    assert sum(map(len, got.values())) == len(texts) + 2
    passage = set(range(39, 44))  # documents with the passage
    assert not got[39][0]["n_spans"]
    for k in range(40, 44):
        r = got[k][0]
        assert r["n_spans"] == 1 and 68 <= r["n_removed"] <= 74 and 39 in r["earlier_doc_ids"]
    for k in range(30):
        assert all(r["n_removed"] == 0 and r["kept"] == texts[k].encode() for r in got[k])
    for k in range(30, 39):  # copies and near copies
        assert got[k][0]["n_removed"] >= 50
    assert passage and got[44][0]["kept"] == b"" and got[45][0]["n_words"] == 0
    cut = windows.shortened(docs)
    assert cut.columns == docs.columns
    left = by_id(cut)
    assert left[44][0]["text"] is None and all((r["text"] or "").encode() == got[k][0]["kept"] for k, v in left.items() for r in v)
    assert left[40][0]["cell"] == "clash" and left[40][0]["n_chars"] == len(left[40][0]["text"])


def test_enough_functions_agree_on_passages_as_similar_as_asked():
    n, like = windows.HASHES, windows.PERCENT / 100
    assert sum(math.comb(n, k) * like**k * (1 - like) ** (n - k) for k in range(windows.AGREE, n + 1)) >= 0.98


def test_passages_whose_pieces_earlier_documents_hold(spark):
    import random

    dice = random.Random(3)
    clean = lambda n: [f"u{dice.randrange(10**9)}" for _ in range(n)]
    early, late = [], []
    for _ in range(20):
        passage = clean(60)
        for k in range(0, 60, 10):  # documents with a piece each, no passage
            early.append([*clean(60), *passage[k : k + 14], *clean(60)])
        late.append((passage, [*clean(50), *passage, *clean(50)], [*clean(50), *passage, *clean(50)]))
    rows = [(k, " ".join(t)) for k, t in enumerate([*early, *(b for _, b, _ in late), *(c for _, _, c in late)])]
    got = {r["doc_id"]: r for r in windows.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["n_removed"] == 0 for k in range(140))
    for k, (passage, _, c) in enumerate(late):
        assert got[140 + k]["n_removed"] == 60 and got[140 + k]["earlier_doc_ids"] == [120 + k]
        assert got[140 + k]["kept"].split() == " ".join(c[:50] + c[110:]).encode().split()


# ---- every operator ------------------------------------------------------------------------------------------------


def test_empty_tables(no_docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    for made in (sharding.shard(no_docs), quality.judge(no_docs), quality.filtered(no_docs), packing.pack(no_docs, path), mixing.mix(no_docs), mixing.mixed(no_docs), jaccard.join(no_docs), jaccard.deduplicated(no_docs), suffixes.dedup(no_docs), windows.dedup(no_docs), windows.shortened(no_docs)):
        assert made.count() == 0


def test_all_null_rows(spark, no_docs):
    rows = spark.createDataFrame([(None,) * 12] * 3, no_docs.schema)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    for made in (sharding.shard(rows), quality.judge(rows), packing.pack(rows, path), mixing.mix(rows), jaccard.join(rows), suffixes.dedup(rows), windows.dedup(rows), windows.shortened(rows)):
        assert made.count() == 3
    assert quality.filtered(rows).count() == 0 and mixing.mixed(rows).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"t{k % 5003}" for k in range(300_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x y z")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(rows).collect()} == {1: 300_000, 2: 300_001, 3: 3}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(rows).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(rows).collect()}[2] >= len(long)
    assert {r["doc_id"]: r["n_removed"] for r in windows.dedup(rows).collect()}[2] >= 299_000


def test_very_long_texts_are_dealt_packed_and_mixed(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, "word " * 200_000, "s"), (2, None, "s"), (3, "few words", None)], "doc_id long, text string, source string")
    assert sorted(r["size"] for r in sharding.shard(rows).collect()) == [1, 10, 1_000_001]
    pieces = [r for r in packing.pack(rows, path).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == 200_001 and max(r["length"] for r in pieces) == 2048
    assert {r["doc_id"]: r["size"] for r in mixing.mix(rows).collect()} == {1: 200_000, 2: 0, 3: 2}


# ---- mixing and near duplicates by other ways ------------------------------------------------------------------------


def _filled(sources, weights, repeats):
    """Targets by another way: the level at which min(repeats x size, weight x level) adds up to all words, in fractions."""
    from fractions import Fraction

    total = sum(n for _, n in sources)
    weight = [weights[k % len(weights)] for k in range(len(sources))]
    low = 0
    bounds = sorted({Fraction(repeats * n, w) for (_, n), w in zip(sources, weight, strict=True)})
    for bound in [*bounds, None]:  # between two neighbouring levels the sum is linear
        full = [Fraction(repeats * n, w) <= low for (_, n), w in zip(sources, weight, strict=True)]
        free = sum(w for w, f in zip(weight, full, strict=True) if not f)
        held = sum(repeats * n for (_, n), f in zip(sources, full, strict=True) if f)
        if free and (level := Fraction(total - held, free)) is not None and (bound is None or level <= bound):
            return [float(min(repeats * n, w * level)) for (_, n), w in zip(sources, weight, strict=True)]
        low = bound
    return [float(repeats * n) for _, n in sources]


def test_targets_by_water_filling():
    import random

    dice = random.Random(9)
    for _ in range(300):
        sources = [(f"s{k:02}", dice.choice([0, 1, 7, 100, 1000, 10**6])) for k in range(dice.randrange(1, 9))]
        got, want = mixing.targets(sources), _filled(sources, mixing.WEIGHTS, mixing.REPEATS)
        assert np.allclose(got, want, rtol=1e-9), sources


def test_mix_draws_every_block_once(spark, monkeypatch):
    import random

    monkeypatch.setattr(mixing, "PARTS", 8)
    dice = random.Random(3)
    rows = [(k, " ".join(["w"] * dice.randrange(1, 60)), dice.choices(["a", "b", "c", None], [30, 6, 2, 1])[0]) for k in range(800)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, block_words=100).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(names, _filled([(s, sizes[s]) for s in names], mixing.WEIGHTS, mixing.REPEATS), strict=True))
    taken, shards = Counter(), Counter()
    for r in got:
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert len({d["pass"] for d in r["draws"]}) == len(r["draws"]) and abs(r["target"] - want[r["source"]]) < 1e-6 * r["target"] + 1e-9
        # whole draws but for the one in which the source's target falls
        taken[r["source"]] += r["taken"]
        for d in r["draws"]:
            shards[r["source"], d["shard"]] += d["words"]
    assert all(taken[s] == round(want[s]) for s in names) and len(got) == len(rows)
    cut = Counter(r["source"] for r in got for d in r["draws"] if d["words"] < r["size"])
    assert max(cut.values(), default=0) <= 3
    # a source's words are dealt to all shards, none far from an even part
    for s in names[:2]:
        assert all(0.3 * taken[s] / 8 < shards[s, k] < 2.5 * taken[s] / 8 for k in range(8))
    key = lambda rows: sorted(((r["doc_id"], r["size"], r["source"], r["draws"]) for r in rows), key=repr)
    assert key(mixing.mix(docs.repartition(5), block_words=100).collect()) == key(got)


def test_mixed_keeps_rows_with_clashing_names_apart(spark):
    rows = [(1, "one two three", "a", None), (1, "one two three", "a", "other"), (None, "four five", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `mixed row` string")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {tuple(r)[3] for r in got.collect()} <= {None, "other", "x"}
    assert sum(len(r["text"].split()) for r in got.collect()) == 8


def test_one_row_of_each_component_stays(spark):
    text = lambda k: f"text number {k} has these words and no others"
    cases = [
        [(None, text(1)), (5, text(1)), (None, text(2))],
        [(3, text(1)), (7, text(1)), (7, text(2))],
        [(3, text(1)), (3, text(1)), (3, text(1).upper())],
        [(None, text(1)), (None, text(1)), (None, ""), (None, ""), (None, None), (4, " \n")],
        [(8, text(3)), (2, text(3)), (2, text(4)), (8, text(4))],
    ]
    want = [{(5, text(1)), (None, text(2))}, {(3, text(1)), (7, text(2))}, None, {(None, text(1)), (None, ""), (None, None), (4, " \n")}, {(2, text(3)), (2, text(4))}]
    for rows, stay in zip(cases, want, strict=True):
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `gone id` string")
        got = [tuple(r)[:2] for r in jaccard.deduplicated(docs).collect()]
        if stay is None:
            assert len(got) == 1 and got[0][0] == 3
        else:
            blanks = [r for r in rows if not (r[1] or "").strip()]
            assert set(got) == stay and len(got) == len(stay) - len(set(blanks)) + len(blanks)


def test_groups_have_fences_of_their_own(spark):
    import random

    dice = random.Random(8)
    text = lambda n, share: " ".join(f"w{dice.randrange(10**6)}" + ("#" if dice.random() < share else "") for _ in range(n))
    rows, k = [], 0
    for source, share, docs in (("plain", 0.0, 900), ("tagged", 0.2, 900), ("small", 0.0, 6)):
        for _ in range(docs):
            rows.append((k, text(80, share), "en", source))
            k += 1
    rows += [(k, text(80, 0.2), "en", "plain"), (k + 1, text(80, 0.2), "en", "tagged"), (k + 2, text(80, 0.2), "en", "small"), (k + 3, text(200, 0.0) + " #", "en", "plain")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[k]["kept"] and got[k + 1]["kept"]  # the same share, another group
    assert got[k + 2]["kept"]  # too few of its own: it leans on its language, half of which is tagged
    assert got[k + 3]["kept"]  # one symbol says nothing
    assert sum(got[j]["kept"] for j in range(k)) >= 0.99 * k
    # sketches of parts add up to the sketch of all
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    whole = sorted(map(tuple, quality.sketches(measured).collect()))
    parts = [quality.sketches(measured.where(f"doc_id % 3 = {j}")) for j in range(3)]
    added = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, added.collect())) == whole
