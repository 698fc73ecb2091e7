"""Prefix trie, whitening and sharding against brute force, odd rows included."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from scriptline.llm import queries, sharding, trie, whitening

SF_DIR = "/root/testdata/sf0.001"


# Prefix trie


def brute_nodes(paths):
    """The contract's columns from {conv_id: ((role, text), ...)}."""
    members = collections.defaultdict(list)
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[c][0] for c in children[node]) or 1
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below[node] = leaves, own + sum(below[c][1] for c in children[node])
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_paths(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append(((turn is not None, turn), role, key, (role, text)))
    return {c: tuple(t[-1] for t in sorted(turns)) for c, turns in found.items()}


def brute_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, ())[:h] + turns[h:]
    return out


def found_nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, shard int, keys string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "p") for r in rows], CONVERSATIONS)


def random_conversations(seed, copies):
    """A hot first turn, copies of one conversation, ties, nulls and turnless stretches."""
    rng, rows = random.Random(seed), []
    for c in range(160):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, 12)):
            turn = rng.choice([t, t, t, None, 3])
            text = "hello" if t == 0 and rng.random() < 0.6 else rng.choice(["é", "", None, "no", f"t{rng.randint(0, 3)}"])
            rows.append((c, turn, rng.choice(["user", "bot", None]), text))
    for c in range(1000, 1000 + copies):
        rows += [(c, t, "user", "again" * t) for t in range(6)]
    return rows


@pytest.mark.parametrize(("seed", "shard_bytes"), [(1, 10), (2, 200), (3, 1 << 20)])
def test_trie_agrees_with_brute_force(spark, seed, shard_bytes):
    rows = random_conversations(seed, copies=70)
    expected = brute_nodes(brute_paths(rows))
    assert found_nodes(trie.nodes(trie.paths(table(spark, rows)), shard_bytes)) == expected


def test_trie_of_rebuilt_conversations(spark):
    rows = random_conversations(4, copies=30) + [(None, 0, "user", "nobody"), (5, None, None, None), (5, None, None, None)]
    expected = brute_nodes(brute_rebuilt(brute_paths(rows)))
    assert found_nodes(trie.nodes(queries.rebuilt(table(spark, rows)), 50)) == expected


def test_trie_of_long_conversations(spark):
    """Deeper than a splitter may be; copies of one text beyond a packed block's worth of keys are cut, too."""
    deep = [(c, t, "user", f"{t}" if t < 1100 else f"{t} {c % 3}") for c in range(8) for t in range(1300)]
    rows = deep + [(9, 0, "user", "x" * 3_000_000)]
    expected = brute_nodes(brute_paths(rows))
    assert found_nodes(trie.nodes(trie.paths(table(spark, rows)), 1 << 12)) == expected


def test_trie_blocks_of_many_ends(spark):
    many = spark.range(3 * trie.BLOCK).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    found = found_nodes(trie.nodes(trie.paths(many), 1 << 12))
    assert found == brute_nodes({c: (("user", "same"),) for c in range(3 * trie.BLOCK)})


def test_trie_skeleton_is_spread_over_shards(spark):
    """A third of all conversations are one text: their keys cut them into shards of about equal size."""
    rows = trie.paths(table(spark, random_conversations(5, copies=100)))
    rows = rows.selectExpr("conv_id", "unhex(array_join(keys, '')) AS path", "sizes")
    splitters = trie._splitters(rows, 16)
    whole = [(bytes(r.path), r.conv_id) for r in rows.collect()]
    sizes = collections.Counter(sum(s <= row for s in splitters) for row in whole)
    assert len(splitters) > 20 and max(sizes.values()) <= 3 * len(whole) / len(splitters)


def test_trie_of_nothing(spark):
    assert found_nodes(trie.nodes(queries.rebuilt(table(spark, [])))) == []
    assert found_nodes(trie.nodes(trie.paths(table(spark, [(None, 1, "user", "a")])))) == []


# Whitening


def brute_components(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    centred = x - x.mean(0)
    values, u = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1][:k], u[:, ::-1][:, :k], values.sum()


def check_whitening(spark, vectors, k, rows=None):
    df = spark.createDataFrame(rows or [(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, key string")
    quantised = whitening.quantised(df, "vec_id", "embedding")
    model = whitening.fit_quantised(quantised, k)
    x, centred, values, u, trace = brute_components(vectors, k)
    assert model.n == len(vectors) and model.identity_error < 1e-9 and model.residual <= whitening.TOLERANCE
    assert np.allclose(model.values, values, rtol=1e-10)
    found = collections.defaultdict(dict)
    for r in whitening.whiten(quantised, model, "vec_id").collect():
        found[r.component].setdefault(r.vec_id, []).append(r)
    usable = [r for r in rows if r[1] in vectors] if rows else list(enumerate(vectors))
    for c in range(k):
        got = np.array([found[c + 1][i][0].whitened for i, *_ in usable])
        want = centred @ u[:, c] / math.sqrt(values[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(found[c + 1][usable[0][0]][0].explained - values[c] / trace) < 1e-10
    n, sums = len(x), x.sum(0)
    for at, (i, *_) in enumerate(usable):
        assert int(found[1][i][0].deviation) == sum(int(d) ** 2 for d in (n * x[at] - sums))
    return model


@pytest.mark.parametrize("seed", range(2))
def test_whitening_agrees_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    spread = np.linspace(3, 1, 80) if seed else np.concatenate([[40, 9], np.linspace(1.1, 1, 78)])
    vectors = (rng.standard_normal((1500, 80)) * spread @ np.linalg.qr(rng.standard_normal((80, 80)))[0]).astype(np.float32).tolist()
    model = check_whitening(spark, vectors, 8)
    assert model.passes > 10  # the filter was at work


def test_whitening_of_few_dimensions(spark):
    rng = np.random.default_rng(7)
    check_whitening(spark, rng.standard_normal((50, 3)).astype(np.float32).tolist(), 3)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = rng.standard_normal((40, 5)).astype(np.float32).tolist()
    odd = [(100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("inf")] + [0.0] * 4, "x"), (104, [], "x"), (105, [1.0], "x")]
    rows = [(i, v, "x") for i, v in enumerate(good)] + odd
    check_whitening(spark, good, 5, rows)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(None, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    for df in (same, same.limit(1), same.limit(0)):
        rows = whitening.quantised(df, "vec_id", "embedding")
        model = whitening.fit_quantised(rows)
        assert whitening.whiten(rows, model, "vec_id").count() == 0 and len(model.values) == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.quantised(line, "vec_id", "embedding")
    assert {r.component for r in whitening.whiten(rows, whitening.fit_quantised(rows), "vec_id").collect()} == {1}


def test_whitening_of_large_entries(spark):
    big = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|overflow|OVERFLOW"):
        whitening.fit_quantised(whitening.quantised(big, "vec_id", "embedding"))
    wide = np.array([[2**40, 3], [5, -(2**41)]])
    assert [int(x) for x in whitening._deviations(wide).to_pylist()] == [2**80 + 9, 25 + 2**82]


def test_whitening_query(spark):
    found = queries.op12_embedding_whitening(spark, SF_DIR).collect()
    n = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert len(found) == 8 * n and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-4
    for c in range(1, 9):
        own = np.array([r.whitened for r in found if r.component == c])
        assert abs(own.mean()) < 1e-9 and abs((own**2).mean() - 1) < 1e-9


# Sharding


def brute_shard(key, tree):
    node = tree
    while node.children:
        drawn = []
        for child in node.children:
            name = child.name if key is None else f"{key}|{child.name}"
            u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            drawn.append((-math.log(u) / child.weight, child.name, child))
        node = min(drawn)[2]
    return node.shard


DOCS = [(i, f"text {i % 7}" * (i % 11)) for i in range(3000)] + [(i, "the same") for i in range(5000, 6500)]
ODD = [(None, None), (None, ""), (7, "again"), (7, "again"), (8, "é" * 100_000), (-3, "x")]


@pytest.fixture(scope="module")
def sharded(spark):
    docs = spark.createDataFrame([(i, t, 3, "s") for i, t in DOCS + ODD], "doc_id long, text string, shard int, slot string")
    return sharding.assign(docs, sharding.cluster(4, 2, 2)).collect()


def test_sharding_agrees_with_brute_force(sharded):
    tree = sharding.cluster(4, 2, 2)
    grown = sharding.with_shard(tree)
    expected = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_shard(i, tree), brute_shard(i, grown)) for i, t in DOCS + ODD)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in sharded) == expected


def test_slots_are_gapless(sharded):
    slots = collections.defaultdict(list)
    for r in sharded:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))


def test_one_more_shard_takes_rows_only_into_itself(sharded):
    moved = {r.grown_shard for r in sharded if r.grown_shard != r.shard}
    share = sum(r.grown_shard == 16 for r in sharded) / len(sharded)
    assert moved == {16} and abs(share - 1 / 17) < 0.02


def test_movement_stays_where_weights_change(spark):
    """A heavier shard: no row moves between subtrees whose weights stay, nor out of the heavier ones."""
    before, after = sharding.cluster(3, 3, 2), sharding.cluster(3, 3, 2, {7: 4.0})
    keys = spark.range(20000).select("id", sharding.shard_of(queries.F.col("id"), before).alias("a"), sharding.shard_of(queries.F.col("id"), after).alias("b"))
    moves = {(r.a, r.b) for r in keys.distinct().collect() if r.a != r.b}
    assert moves and all(b // 6 == 1 for _, b in moves)  # into the region of shard 7 alone
    assert all(b == 7 or a // 6 != 1 or b // 2 == 3 for a, b in moves)  # inside it, into its rack alone
    assert not any(a // 2 == b // 2 for a, b in moves if b != 7)  # inside the rack, into itself alone


def test_shards_get_rows_by_weight(spark):
    tree = sharding.cluster(2, 2, 2, {0: 6.0, 5: 3.0})
    found = collections.Counter(r.s for r in spark.range(40000).select(sharding.shard_of(queries.F.col("id"), tree).alias("s")).collect())
    for shard in range(8):
        want = {0: 6.0, 5: 3.0}.get(shard, 1.0) / 15
        assert abs(found[shard] / 40000 - want) < 0.01


def test_sharding_of_nothing(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id string, text string"), sharding.cluster(4, 2, 2)).count() == 0
