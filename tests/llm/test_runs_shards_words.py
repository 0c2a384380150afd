"""Periodic runs, shards and spelling variants, against brute force and SQL."""

import collections
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketlens.llm import hash_tree, periodic_runs, spelling


def _equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    cols = got.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_hash_tree", "op13_spelling_variants"])
def test_whole_table_equals_sql(spark, sf, name):
    _equals_sql(spark, sf, name)


# --- periodic runs ------------------------------------------------------------


def _runs_by_hand(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period of the stretch
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    r = random.Random(7)
    texts = []
    for _ in range(1500):
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 5])]) for _ in range(r.randrange(90))]
        if w and r.random() < 0.6:
            a, p = r.randrange(len(w)), r.randrange(1, 15)
            w = w[:a] + [w[min(a + (i - a) % p, len(w) - 1)] for i in range(a, len(w))]
        if r.random() < 0.3:
            w = w + [f"x{i}" for i in range(3)] + w
        texts.append(w)
    got = periodic_runs.runs_of_texts([" ".join(w) for w in texts])
    for w, (runs, collapsed) in zip(texts, got, strict=True):
        want = _runs_by_hand(w)
        assert sorted(runs, key=lambda x: (x[0], x[2])) == runs and sorted(runs) == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_rare_words_split_until_settled():
    import numpy as np

    # 9 occurs once; without it 3 occurs too rarely on either side.
    ids = np.array([1, 3, 1, 3, 1, 1, 3, 9, 3, 1, 1, 1, 1, 1, 1])
    begins, ends = periodic_runs.surviving(ids, np.array([0]), np.array([len(ids)]), 4, 6)
    assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(9, 15)]


def test_runs_of_long_texts():
    runs, collapsed = periodic_runs.runs_of_texts([" ".join(["a", "b", "c"] * 100_000)])[0]
    assert runs == [(0, 300_000, 3)] and collapsed == "a b c"
    assert periodic_runs.runs_of_texts(["x" * 1_000_000])[0] == ([], "x" * 1_000_000)


def test_runs_of_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("runs", F.lit("mine")).withColumn("collapsed", F.lit(1))
    marked, names = periodic_runs.mark_runs(clash, group_bytes=1000)
    assert names == {"runs": "runs_", "collapsed": "collapsed_"}
    got = marked.select("doc_id", "text", "runs", names["collapsed"], names["runs"]).collect()
    assert len(got) == odd.count() and all(r["runs"] == "mine" for r in got)
    for r in got:
        words = [w for w in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        if len(words) < 1000:
            assert [tuple(x) for x in r[names["runs"]]] == _runs_by_hand(words)
    assert periodic_runs.mark_runs(nothing)[0].count() == 0
    best = spark.sql("SELECT array() AS runs").select(periodic_runs.strongest(F.col("runs").cast("array<struct<start:long,length:long,period:long>>")).alias("b"))
    assert best.first().b is None
    with pytest.raises(ValueError):
        periodic_runs.mark_runs(odd, repeats=3)


def test_strongest_run_breaks_ties_by_start(spark):
    runs = spark.sql(
        "SELECT array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 5L, 'length', 13L, 'period', 3L),"
        " named_struct('start', 9L, 'length', 26L, 'period', 6L)) AS runs"
    )
    assert tuple(runs.select(periodic_runs.strongest(F.col("runs")).alias("b")).first().b) == (5, 13, 3)


# --- shards -------------------------------------------------------------------


def _shards(spark, tree, n=4000):
    rows = hash_tree.place(spark.range(n), tree, F.col("id"), "shard").collect()
    return {r.id: r.shard for r in rows}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = hash_tree.even_tree(40)
    assert hash_tree.even_tree(41) == tree.grown()
    before, after = _shards(spark, tree), _shards(spark, tree.grown())
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(after[i] == 40 for i in moved)
    sizes = collections.Counter(before.values())
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 160


def test_weight_changes_stay_in_their_subtree(spark):
    tree = hash_tree.even_tree(16)
    region, rest = tree.regions[0], tree.regions[1:]
    heavier = hash_tree.Tree(((tuple((s, 3.0 if s == 1 else w) for s, w in region[0]), *region[1:]), *rest))
    before, after = _shards(spark, tree), _shards(spark, heavier)
    place = {s: (r, k) for r, racks in enumerate(tree.regions) for k, rack in enumerate(racks) for s, _ in rack}
    moved = [(place[before[i]], place[after[i]]) for i in before if before[i] != after[i]]
    assert moved
    for (r0, k0), (r1, k1) in moved:
        assert r1 == 0  # only the heavier region gains
        if r0 == 0:
            assert k1 == 0  # inside it only the heavier rack
    share = sum(1 for s in after.values() if s == 1) / len(after)
    assert abs(share - 3 / 18) < 0.03


def test_weightless_shards_are_empty(spark):
    tree = hash_tree.Tree(((((0, 1.0), (1, 0.0)), ((2, 0.0),)), (((3, 0.0),),)))
    assert set(_shards(spark, tree, 200).values()) == {0}
    for bad in ([(0, 0.0)], [(0, 1.0), (0, 1.0)], [(0, -1.0), (1, 2.0)]):
        with pytest.raises(ValueError):
            hash_tree.Tree(((tuple(bad),),))


@pytest.mark.parametrize(("bucket_rows", "chunk"), [(100_000, 10_000), (7, 3)])
def test_slots_are_gapless_and_rows_whole(spark, bucket_rows, chunk):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("doc_id"), (F.col("id") % 2).cast("int").alias("shard")
    )
    got = hash_tree.shard_rows(rows, "shard", bucket_rows=bucket_rows, chunk=chunk).collect()
    assert collections.Counter((r.doc_id, r.shard) for r in got) == collections.Counter(map(tuple, rows.collect()))
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(1 for r in got if r.shard == s)))
    again = hash_tree.shard_rows(rows.repartition(5), "shard", bucket_rows=11).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_shards_of_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("region_of_row", F.lit("x"))
    placed = hash_tree.place(clash, hash_tree.even_tree(5), F.col("doc_id"), "shard")
    assert placed.columns == [*clash.columns, "shard"] and placed.where("shard IS NULL").isEmpty()
    assert placed.where("doc_id = 3").select("shard").distinct().count() == 1
    empty = hash_tree.place(nothing.select("doc_id"), hash_tree.even_tree(5), F.col("doc_id"), "shard")
    assert hash_tree.shard_rows(empty, "shard").count() == 0


# --- spelling -----------------------------------------------------------------


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _random_words(seed, n, shortest=1):
    r = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(r.choice("abÀÿ") for _ in range(r.randrange(shortest, 9)))
        words.add(w)
        if len(w) > 1:
            i = r.randrange(len(w))
            words.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("ab") + w[i:], w[:i] + "x" + w[i + 1 :]]))
    return sorted(w for w in words if w)


@pytest.mark.parametrize(("tile", "block"), [(512, 4096), (4, 3)])
def test_near_words_equal_brute_force(spark, tile, block):
    words = _random_words(3, 150)
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = spelling.near_words(df, tile=tile, block=block, task_rows=100).collect()
    want = {(a, b) for a in words for b in words if a != b and _near(a, b)}
    assert len(got) == len(want) and {(r.word, r.near) for r in got} == want
    assert all(r.n == len(r.word) and r.near_n == len(r.near) for r in got)


def test_forms_and_roots_equal_brute_force(spark):
    r = random.Random(5)
    counts = {w: r.choice([3, 3, 6, 7, 14, 15, 40, 200]) for w in _random_words(9, 120, shortest=5)}
    counts |= {"x" * 3000: 5, "x" * 3001: 11, "x" * 2999 + "y": 11}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {row.word: row for row in spelling.variant_forms(df).collect()}
    assert set(got) == set(counts)
    form = {}
    for w, n in counts.items():
        near = sorted((-counts[b], b) for b in counts if b != w and _near(w, b))
        form[w] = near[0][1] if near and -near[0][0] >= 2 * n else None
        row = got[w]
        assert (row.form, row.n, row.n_near, row.form_n) == (form[w], n, len(near), counts[form[w]] if form[w] else None)
    for w in counts:
        last = w
        while form[last]:
            last = form[last]
        assert got[w].root == last


def test_words_of_odd_rows(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "ÀB KelvinK x×y 12ab"), (None, None), (2, "")], "doc_id long, text string")
    got = [tuple(r) for r in spelling.runs_of_letters(docs).collect()]
    assert got == [("1", "Àb"), ("1", "kelvin"), ("1", "x×y"), ("1", "ab")]
    words = spelling.word_counts(spelling.runs_of_letters(odd).select(F.col("run").alias("word")), least=1)
    assert words.where("word = 'words'").first().n == 1 and words.where("length(word) < 5").isEmpty()
    assert spelling.variant_forms(spelling.word_counts(spelling.runs_of_letters(nothing).select(F.col("run").alias("word")))).count() == 0


def test_one_run_in_97_loses_a_letter(spark, tmp_path):
    texts = [(i, "Alphabet soup") for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for i, _ in texts:
        h = zlib.crc32(f"{i}:alphabet".encode())
        w = "alphabet"
        want[w[: h % 8] + w[h % 8 + 1 :] if h % 97 == 0 else w] += 1
    want = {w: n for w, n in want.items() if n >= 3}
    got = entry.queries()["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert {r.word: r.n for r in got} == want
