import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.components import components
from pyspark.sql import functions as F

from .conftest import words


def slow_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, n=3):
    fps = {i: slow_fingerprint(t, n) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (fps[i], find(i)) for i in ids}


def rows_with_copies(rng):
    rows = []
    for k in range(40):
        base = words(rng, 200)
        rows.append((len(rows), " ".join(base)))
        for _ in range(k % 5):
            near = list(base)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(200)] = "changed"
            rows.append((len(rows), "\n".join(near).upper()))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (len(rows) + 3, "one"), (len(rows) + 4, "One"), (len(rows) + 5, "long " * 30000)]


def test_matches_brute_force(docs_of, rng):
    rows = rows_with_copies(rng)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert got == slow_components(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_full_cells_are_split_without_losing_links(docs_of, rng):
    rows = rows_with_copies(rng)
    whole = sorted(map(tuple, simhash.near_duplicates(docs_of(rows)).collect()))
    assert sorted(map(tuple, simhash.near_duplicates(docs_of(rows), block=2).collect())) == whole


def test_all_pairs_within_radius_meet(spark, rng):
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) % 2**64).count("1") <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in fps)


def test_empty_null_ids_repeats_and_extra_columns(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "x y z w v u")]
    df = docs_of(rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a long, b long")
    got = components(edges).collect()
    assert {r.node for r in got} == set(range(301)) and {r.root for r in got} == {0}
    assert components(edges.where("a < 0")).count() == 0


def slow_sketch(text, n=5, width=16):
    """The long fingerprint bit by bit, in whole numbers."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)]
    out = 0
    for k in range(width):
        odd = xxhash.xxh64_intdigest(b"%d" % k, 7) | 1
        made = []
        for x in s:
            h = xxhash.xxh3_64_intdigest(x) * odd % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            made.append(h ^ h >> 32)
        for b in range(64):
            if 2 * sum(h >> b & 1 for h in made) > len(made):
                out |= 1 << (64 * k + b)
    return out


def slow_similar(rows, similarity=0.8):
    sketches = {i: slow_sketch(t) for i, t in rows}
    radius, root = simhash.radius_of(similarity), {i: i for i in sketches}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sketches)
    for i in ids:
        for j in ids:
            if i < j and bin(sketches[i] ^ sketches[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_sketch_bits():
    for text in ("", "a b", "a b c d e", "The quick brown fox jumps over the lazy dog again and again"):
        assert int.from_bytes(simhash.sketch(text.encode())[0], "little") == slow_sketch(text)


def shingle_similarity(a, b, n=5):
    x, y = ({tuple(t.lower().split()[k : k + n]) for k in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_similar_texts_group_and_others_do_not(docs_of, rng):
    rows, family = [], {}
    for k in range(40):
        base = words(rng, rng.choice([60, 200, 500]), 5000)
        for c in range(1 + k % 4):
            near = list(base)
            for _ in range(c and len(base) // 60):
                near[rng.randrange(len(base))] = "changed"
            family[len(rows)] = k
            rows.append((len(rows), " ".join(near).upper()))
    rows += [(900, None), (901, ""), (902, rows[3][1].lower()), (None, rows[3][1])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows)).collect()}
    texts = dict(rows)
    for i in family:
        for j in family:
            if i < j and family[i] == family[j] and shingle_similarity(texts[i], texts[j]) >= 0.85:
                assert got[i] == got[j], (i, j)
            if family[i] != family[j]:
                assert got[i] != got[j]
    assert got[902] == got[3] == got[None] and got[900] == got[901] == 900
    whole = sorted(map(str, simhash.similar_documents(docs_of(rows)).collect()))
    assert whole == sorted(map(str, simhash.similar_documents(docs_of(rows), block=2).collect()))
    assert simhash.similar_documents(docs_of([])).count() == 0


def test_close_rows_match_brute_force(rng):
    import numpy as np

    x = np.random.default_rng(5).integers(0, 2**63, (40, 8), dtype=np.uint64)
    y = np.concatenate([x[:20] ^ np.uint64(1), x[20:]])
    for radius in (0, 7, 8, 240, 260):
        i, j = simhash._close(x, y, radius)
        want = {(a, b) for a in range(40) for b in range(40) if sum(bin(int(p ^ q)).count("1") for p, q in zip(x[a], y[b])) <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_groups_are_those_of_exact_shingle_similarity(docs_of, rng):
    rows = []
    for k in range(60):
        base = words(rng, rng.choice([9, 24, 60, 200]), 5000)
        rows.append((len(rows), " ".join(base)))
        for c in range(1, 5):
            cut = max(1, len(base) * c // 20)
            rows.append((len(rows), " ".join(base[:-cut] + words(rng, cut, 5000))))
    rows += [(len(rows) + k, "same " * 90 + " ".join(words(rng, 40, 5000))) for k in range(6)]
    rows.append((2000, None))
    texts = {i: t or "" for i, t in rows}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and shingle_similarity(texts[i], texts[j]) >= 0.8 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in texts}
    assert len(set(want.values())) < len(want) - 60
    for block in (2048, 3):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows), block=block).collect()} == want


def test_documents_of_one_id_or_none_are_told_apart(docs_of, rng):
    a, b, c = (words(rng, 30, 5000) for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["more"])), (None, " ".join(c)), (None, " ".join(c)), (None, " ".join(b + ["x"])), (3, None), (4, ""), (5, " ".join(c) + " y", "fr"), (6, "alone"), (6, "alone", "de")]
    got = sorted(((r.doc_id, r.text, r.lang) for r in simhash.one_of_each(docs_of(rows).withColumn("row", F.lit(1)).withColumn("several", F.lit(2))).collect()), key=str)
    want = [(1, " ".join(a), "en"), (1, " ".join(b), "en"), (5, " ".join(c) + " y", "fr"), (3, None, "en"), (6, "alone", "de")]
    assert got == sorted(want, key=str)


def test_a_group_without_a_common_hub_is_connected(docs_of, rng):
    """A chain of texts, each like the next one only, and a hub that few are like, in parts of three."""
    base = words(rng, 60, 9000)
    rows = []
    for k in range(30):
        rows.append((k, " ".join(base)))
        base = base[2:] + words(rng, 2, 9000)
    rows += [(100 + k, " ".join(base[:58] + [f"own{k}", "end"])) for k in range(40)]
    texts = dict(rows)
    root = {i: i for i in texts}
    for _ in range(40):
        for i in texts:
            for j in texts:
                if i < j and root[i] != root[j] and shingle_similarity(texts[i], texts[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    for block in (3, 512):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows), block=block).collect()} == root


def test_no_pair_at_the_similarity_is_left_to_chance(docs_of):
    """Two texts at 0.8 of which no two least hashes agree, and a lead near the first whose own neighbour is not."""
    import numpy as np

    text = "w899 w139 w433 w1012 w3613 w2628 w1870 w2356 w569 w4579 w2517 w3791 w3676"
    got = simhash.similar_documents(docs_of([(1, text), (2, text.rsplit(" ", 1)[0] + " end"), (3, "a b c d e f g")]))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}
    bits = np.zeros((4, 1024), np.uint8)
    for k, n in enumerate((0, 200, 400, 900)):
        bits[k, :n] = 1
    a, b = simhash._near_forest(np.packbits(bits, axis=1).view(np.uint64), 2, 246)
    assert {*a.tolist(), *b.tolist()} == {0, 1, 2} and len(a) == 2  # a forest of all three


def test_common_shingles_come_last_without_losing_links(docs_of, rng):
    lines = [" ".join(words(rng, 14, 5000)) for _ in range(3)]
    rows = []
    for k in range(90):
        base = words(rng, rng.choice([1, 12, 30]), 5000)
        for c in range(1 + k % 2):
            rows.append((len(rows), " ".join(base[: len(base) - c] + ["end"] * c) + "\n" + "\n".join(lines[: k % 4])))
    whole = sorted(map(tuple, simhash.similar_documents(docs_of(rows)).collect()))
    assert 40 < len({c for _, c in whole}) < len(rows)
    assert whole == sorted(map(tuple, simhash.similar_documents(docs_of(rows), common=4).collect()))
