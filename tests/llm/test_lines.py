import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import lines, queries


def brute(rows, m=2, w=lines.MIN_WORDS):
    """rows: (doc_id, text). The longest earlier match of every suffix of non-blank trimmed lines, by direct comparison; order doc_id, then place."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0]))
    seen, out, known = {}, {}, []
    for d, (i, t) in enumerate(docs):
        raw = t.split("\n")
        seq = [(k, x.strip("\t\n\x0b\x0c\r ")) for k, x in enumerate(raw) if x.strip("\t\n\x0b\x0c\r ")]
        known.append([x for _, x in seq])
        own, runs, reach = known[d], [], 0
        for p, x in enumerate(own):
            best = (0,)
            for e, q in seen.get(x, []):
                n = 0
                while p + n < len(own) and q + n < len(known[e]) and own[p + n] == known[e][q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, e, q)
            n = best[0] if best[0] >= m else int(best[0] > 0 and len(x.split()) >= w)
            if n and p + n > reach:
                if n < best[0]:
                    best = (n, *seen[x][0])
                runs.append((p, n, docs[best[1]][0], best[2]))
                reach = p + n
            seen.setdefault(x, []).append((d, p))
        gone = {seq[k][0] for p, n, _, _ in runs for k in range(p, p + n)}
        out[i, t] = ("\n".join(x for k, x in enumerate(raw) if k not in gone), len(seq), len(gone), runs)
    return sorted(((i, None, 0, 0, []) if t is None else (i, *out[i, t]) for i, t in rows), key=str)


def rows_of(rng):
    pool = [f"line {k} text" for k in range(60)]
    run = pool[:7]
    rows = []
    for i in range(80):
        body = [rng.choice(pool) if rng.random() < 0.4 else f"own {i} {k}" for k in range(rng.randrange(0, 12))]
        if i % 4 == 0:
            body[2:2] = run[: rng.randrange(2, 8)]
        if i % 5 == 0:
            body.insert(rng.randrange(len(body) + 1), "")
        rows.append((i, "\n".join(f"  {x}\t" if i % 7 == 0 else x for x in body)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "same\n" * 50), (104, "x" * 200000 + "\nline 3 text\nline 4 text"), (105, rows[8][1]), (106, rows[8][1])]


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted, [tuple(x) for x in r.runs]) for r in df.collect()), key=str)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_matches_brute_force(docs_of, rng, m):
    rows = rows_of(rng)
    want = brute(rows, m)
    assert result(lines.line_dedup(docs_of(rows), m)) == want
    assert m > 2 or max(n for r in want for _, n, _, _ in r[4]) == 49  # far deeper than the least run


def test_sql_says_the_same(spark, docs_of, rng, tmp_path):
    docs_of(rows_of(rng) + [(3, "line 1 text\nline 2 text"), (3, "line 1 text\nline 2 text")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op3_line_dedup(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP3_SQL).fetchall(), key=str)


def test_ranks_are_intervals_of_the_suffix_array(docs_of, rng):
    rows = rows_of(rng)
    ids = {(r.row, r.place): (r.x, r.y) for r in lines.line_ids(docs_of(rows)).collect()}
    seqs = {}
    for (row, place), x in sorted(ids.items()):
        seqs.setdefault(row, []).append(x)
    every = lines.suffix_ranks(docs_of(rows))
    assert len(every) == 6  # 49 lines of the same text share 32 at most with a power of two
    for k, ranks in enumerate(every):
        h = 1 << k
        prefix = {(row, p): tuple(s[p : p + h]) for row, s in seqs.items() for p in range(len(s) - h + 1)}
        count = {}
        for v in prefix.values():
            count[v] = count.get(v, 0) + 1
        got = {(r.row, r.place): r["rank"] for r in ranks.collect()}
        assert set(got) == {x for x, v in prefix.items() if count[v] > 1}
        order = sorted(got, key=lambda x: prefix[x])
        assert [got[x] for x in order] == sorted(got.values()) and len(set(got.values())) == len({prefix[x] for x in order})


def test_a_chain_of_partial_copies_has_its_longest_sources(docs_of):
    """Runs of every length against several earlier documents that share less or more of them."""
    a = [f"a{k}" for k in range(40)]
    rows = [(k, "\n".join(a[:n] + [f"end {k}"])) for k, n in enumerate((3, 17, 5, 8, 40, 21, 2, 1, 33))] + [(20, "\n".join(a[7:19] + a[2:9] + a[30:])), (21, "\n".join(a[7:19] + a[2:9]))]
    assert result(lines.line_dedup(docs_of(rows))) == brute(rows)


def test_empty_repeats_nulls_and_clashing_columns(docs_of):
    assert lines.line_dedup(docs_of([])).count() == 0
    rows = [(2, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb"), (1, "z\na\nb"), (None, None)]
    df = docs_of(rows).withColumn("row", F.lit(1)).withColumn("ats", F.lit(2)).withColumn("n_lines", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("_ats", F.lit(7)).withColumn("_row", F.lit("r"))
    out = lines.line_dedup(df)
    assert result(out) == brute(rows) and {(r._ats, r._row, r.row, r["rank"]) for r in out.collect()} == {(7, "r", 1, 0)}


def test_long_single_lines_go_in_the_pipeline(spark, docs_of, rng):
    import corpus_pipeline

    long, short = (" ".join(f"w{k}" for k in range(n)) for n in (lines.MIN_WORDS, lines.MIN_WORDS - 1))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n {long}\nd"), (3, long), (4, f"e\n{short}\nf"), (5, f"g\n{short}\nh"), (6, f"{long}\nown\n{long}"), (7, None)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs_of(rows), "").collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 4: rows[3][1], 5: rows[4][1], 6: "own", 7: None}
