import random
import time

import numpy as np

from folio.llm import neardup
from folio.llm.words import words
from folio.session import write_shared


def brute(rows, width=3, least=12, t=0.5):
    sets = [(k, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) for k, x in rows if x and len(w := words(x)) >= least]
    out = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            j = len(x & y) / len(x | y)
            if j >= t and a != b:
                out[min(a, b), max(a, b)] = j
    return out


def made(seed, n=150):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(900)]
    rows = []
    for k in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(12, 70))]
        rows.append((f"k{k:04}", " ".join(w)))
        for c in range(r.choice([0, 0, 1, 3])):
            e = list(w)
            for _ in range(max(1, len(e) // 14)):
                e[r.randrange(len(e))] = r.choice(vocab)
            rows.append((f"k{k:04}-{c}", " ".join(e).upper() if c else ", ".join(e)))
    return rows


def test_against_brute_force(spark):
    rows = made(1) + [("null", None), ("blank", ""), ("short", "v1 v2 v3"), ("long", "v1 v2 v3 " * 20_000)]
    rows += [rows[0], ("copy", rows[0][1])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "id string, t string, cls string, fp int")
    links, members = neardup.near_duplicates(df, "id", "t")
    got = {(r.key_a, r.key_b) for r in neardup.key_pairs(links, members).collect()}
    want = brute(list(dict.fromkeys(rows)))
    assert not got - want.keys()
    assert got == want.keys()
    counts = {r.key: r for r in neardup.link_counts(links, members).collect()}
    assert counts["copy"].cls == counts[rows[0][0]].cls and counts["copy"].copies == 2
    assert neardup.near_duplicates(df.limit(0), "id", "t")[0].count() == 0


def test_large_shards_are_cut_into_blocks_without_loss(spark):
    rows = made(2, 40)
    df = spark.createDataFrame(rows, "id string, t string")
    normal = {(r.key_a, r.key_b) for r in neardup.key_pairs(*neardup.near_duplicates(df, "id", "t")).collect()}
    blocks = {(r.key_a, r.key_b) for r in neardup.key_pairs(*neardup.near_duplicates(df, "id", "t", shard_rows=1)).collect()}
    assert normal == blocks and normal


def test_records_of_different_parts_are_not_compared(spark):
    rows = [(p, f"{p}{k}", t) for p in ("x", "y") for k, t in made(3, 20)]
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, "p string, id string, t string"), "id", "t", within="p")
    got = {(r.part, r.key_a, r.key_b) for r in neardup.key_pairs(links, members).collect()}
    assert got == {(p, p + a, p + b) for p in ("x", "y") for a, b in brute(made(3, 20))}


def prints(r, n):
    values = [r.getrandbits(128) for _ in range(n)]
    values += [v ^ (3 << 2 * r.randrange(64)) for v in values[: n // 4]]
    return np.array([v & (1 << 64) - 1 for v in values], dtype=np.uint64), np.array([v >> 64 for v in values], dtype=np.uint64)


def test_trees_return_all_within_the_radius():
    lo, hi = prints(random.Random(5), 240)
    group = np.sort(np.arange(len(lo)) % 7)
    forest = neardup.BKForest(group, lo, hi)
    for radius in (0, 3, 43):
        q, node = forest.within(np.arange(len(lo)), forest.root_of, lo, hi, radius)
        every = range(len(lo))
        want = {(i, j) for i in every for j in every if group[i] == group[j] and neardup.distances(lo[[i]], hi[[i]], lo[[j]], hi[[j]])[0] <= radius}
        assert set(zip(q.tolist(), node.tolist(), strict=True)) == want and len(q) == len(want)
    few = neardup.BKForest(group, lo, hi)
    few.within(np.arange(len(lo)), few.root_of, lo, hi, 3)
    assert few.visited < 0.6 * sum(np.bincount(group) ** 2)


def test_cells_pair_sides_and_count_repeated_rows_once():
    lo, hi = prints(random.Random(6), 40)
    n, cell = len(lo), np.zeros(len(lo), dtype=np.int64)
    many = np.full(2 * n, neardup.MANY)
    i, j, _ = neardup.cell_pairs(np.tile(cell, 2), np.tile(lo, 2), np.tile(hi, 2), many, many, 64, 0.5)
    assert len(i) == n * (n - 1) // 2
    i, j, _ = neardup.cell_pairs(np.where(np.arange(n) < 20, 5, 6), lo, hi, many[:n], many[:n], 64, 0.5)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(20, n) for b in range(20)]


def test_a_pair_can_reach_the_similarity_at_its_first_shared_shingle():
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 40, r.integers(5, 40))) for _ in range(2))
        shared = np.intersect1d(a, b)
        if len(shared) and len(shared) >= 0.5 * len(np.union1d(a, b)):
            rest = [np.array([(x >= shared[0]).sum()]) for x in (a, b)]
            assert neardup.can_reach(rest[0], np.array([len(a)]), rest[1], np.array([len(b)]), 0.5).all()


def test_only_pairs_whose_sizes_and_places_allow_it_are_compared():
    r = np.random.default_rng(8)
    n = 600
    size = r.integers(10, 90, n)
    rest = size - (size * r.uniform(0.2, 0.5, n)).astype(int)
    size[:5] = rest[:5] = neardup.MANY
    bits = r.integers(0, 2**63, (4, n)).astype(np.uint64)
    for sides in ([0], [1, 2]):
        cell = (r.integers(0, 3, n) << 2) | r.choice(sides, n)
        for both in (None, 96):
            i, j, compared = neardup.cell_pairs(cell, bits[0], bits[1], rest, size, 48, 0.5, None if both is None else (bits[2], bits[3], both))
            x, y = (v.reshape(-1) for v in np.indices((n, n)))
            keep = (cell[x] >> 2 == cell[y] >> 2) & ((x < y) if sides == [0] else (cell[x] & 3 == 2) & (cell[y] & 3 == 1))
            can = keep & neardup.can_reach(rest[x], size[x], rest[y], size[y], 0.5)
            d = neardup.distances(bits[0][x], bits[1][x], bits[0][y], bits[1][y])
            want = can & (d <= 48)
            if both:
                want &= d + neardup.distances(bits[2][x], bits[3][x], bits[2][y], bits[3][y]) <= both
            pairs = {(min(p), max(p)) if sides == [0] else p for p in zip(i.tolist(), j.tolist(), strict=True)}
            assert pairs == set(zip(x[want].tolist(), y[want].tolist(), strict=True)) and len(i) == len(pairs) > 50
            assert can.sum() <= compared < 0.3 * keep.sum()


def test_both_fingerprints_miss_hardly_any_pair_and_keep_few_unlike_ones():
    r = np.random.default_rng(4)
    seeds = neardup._seeds(2 * neardup.LETTERS)
    first, both = neardup.radius_for(0.5, neardup.MISS / 10), neardup.radius_for(0.5, 0.9 * neardup.MISS, 2 * neardup.LETTERS)
    for shared, most in ((60, 0), (8, 3)):  # of 90 shingles each: at 0.5, and at 0.05
        sets = [r.integers(0, 2**32, 180 - shared).astype(np.uint32) for _ in range(1000)]
        flat = np.concatenate([np.concatenate([s[:90], s[-90:]]) for s in sets])
        letters = neardup.min_hashes(np.arange(0, len(flat) + 1, 90), flat, seeds) & 3
        d = letters[:, ::2] != letters[:, 1::2]
        near = (d[: neardup.LETTERS].sum(axis=0) <= first) & (d.sum(axis=0) <= both)
        assert (near.sum() if shared == 8 else (~near).sum()) <= most


def test_radius_misses_hardly_any():
    assert neardup.radius_for(0.5) == 39 and neardup.radius_for(1.0) == 0


def test_sketch_never_takes_a_shared_shingle_for_a_single_one(spark):
    rows = [(f"k{i}", f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i} l{i} one two three") for i in range(30)]
    p = neardup.fingerprints(spark.createDataFrame(rows, "id string, t string"), "id", "t", width=3, min_words=12)
    codes = neardup.sketch_counts(p)
    _, off, sh = neardup.shingle_sets([t for _, t in rows], 3, {}, np.full(30, neardup.xxhash.xxh64_intdigest(""), dtype=np.uint64))
    value, n = np.unique(sh, return_counts=True)
    code = codes[neardup.cells_of(value)]
    assert (code[n > 1] > 1).all() and (neardup.LEAST[code] * 2.2 >= n).all() and (code[n == 1] == 1).mean() > 0.9


def test_every_pair_at_the_threshold_meets_in_a_shard(spark):
    r = random.Random(11)
    texts = []
    for _ in range(400):
        own = [f"v{r.randrange(5000)}" for _ in range(63)]
        texts += [own, own[:43] + [f"v{r.randrange(5000)}" for _ in range(20)]]
    df = spark.createDataFrame([(f"k{i}", " ".join(w)) for i, w in enumerate(texts)], "id string, t string")
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in texts]
    want = {tuple(sorted((f"k{i}", f"k{i + 1}"))) for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.5 * len(sets[i] | sets[i + 1])}
    assert len(want) > 350
    links, members = neardup.near_duplicates(df, "id", "t")
    got = {tuple(sorted((x.key_a, x.key_b))) for x in neardup.key_pairs(links, members).collect()}
    assert got == want


def test_turns_lose_no_pair(spark, monkeypatch):
    rows = made(4, 30)
    monkeypatch.setattr(neardup, "TURNS", 3)
    got = [(r.key_a, r.key_b) for r in neardup.key_pairs(*neardup.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t")).collect()]
    assert set(got) == brute(rows).keys() and len(got) == len(set(got))


def test_what_a_shared_table_shuffled_goes_with_its_end(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}

    before = shuffled()
    table = write_shared(spark.range(5000).repartition(4, "id"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and table.count() == 5000
