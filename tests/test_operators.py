"""Operators against plain Python folds on small inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from adjalog import __main__ as cli
from adjalog import registry
from adjalog.functions import aggmerge, codecs
from adjalog.operators import batches, caches, fold, graph, graph_log, kv, lifecycle, merges, ordered
from adjalog.sources import files
from adjalog.streaming import logs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_write_wins_model(spark):
    rng = random.Random(1)
    log = [(i, rng.randrange(5), rng.randrange(5), rng.randrange(2)) for i in range(200)]
    state = {}
    for _, a, b, op in log:
        state[a, b] = op
    got = fold.last_write_wins(spark.createDataFrame(log, "seq long, src long, dst long, op int"), ["src", "dst"])
    assert rows(got) == sorted((k for k, v in state.items() if v), key=str)


def test_degree_graph(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 0), (1, 2)], "src long, dst long")
    got = {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(edges, spark.createDataFrame([(9,)], "id long")).collect()}
    assert got == {0: (3, 1), 1: (2, 1), 2: (0, 2), 3: (0, 1), 9: (0, 0)}


def test_self_loop_and_walks(spark):
    edges = spark.createDataFrame([(4, 4), (1, 2)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (4,)], "id long")
    p = {(r.start, r.id): r.p for r in graph.walk_distribution(edges, starts, 3, 0.2).collect()}
    assert p[4, 4] == pytest.approx(1) and p[1, 2] == pytest.approx(0.8) and p[1, 1] == pytest.approx(0.2)
    assert {r.walk: r.id for r in graph.random_walks(edges, starts, 3).collect()}[4] == 4


def test_range_delete_model(spark):
    rng = random.Random(2)
    log = [(i, rng.randrange(60)) for i in range(300)]
    dels = [(rng.randrange(300), lo := rng.randrange(60), lo + rng.randrange(15)) for _ in range(12)]
    want = sorted(((s, k) for s, k in log if not any(lo <= k < hi and d > s for d, lo, hi in dels)), key=str)
    got = fold.apply_range_deletes(spark.createDataFrame(log, "seq long, key long"), spark.createDataFrame(dels, "seq long, lo long, hi long"))
    assert rows(got.select("seq", "key")) == want


@pytest.mark.parametrize("counter,estimate", [(0, 0), (31, 31), (32, 32), (33, 34), (63, 94), (64, 96), (254, 7904), (255, 2147483647)])
def test_morris_codec(spark, counter, estimate):
    df = spark.createDataFrame([(counter,)], "c int")
    assert df.select(graph.morris_estimate(df.c)).first()[0] == estimate


def test_full_morris_counters(spark):
    edges = spark.range(9000).selectExpr("id + 10 AS src", "1L AS dst").union(spark.range(40000).selectExpr("id + 10 AS src", "2L AS dst"))
    got = registry.g_morris_degree(edges)
    assert got.where("bounded").count() == got.count() == 40002
    cases = [(2007, 2147483647, False), (2008, 2147483647, True), (31616, 7904, True), (31617, 7904, False), (100, 25, True), (100, 24, False), (100, 401, False)]
    df = spark.createDataFrame(cases, "degree long, estimate long, want boolean")
    assert df.where(graph.morris_bounded(F.col("degree"), F.col("estimate")) != F.col("want")).count() == 0


def test_merge_golden(spark):
    log = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, ""), (1, 3, 2, "y"), (2, 1, 1, "q"), (2, 2, 0, None)], "key long, seq long, op int, value string")
    assert rows(fold.merge_fold(log, ["key"], merges.string_append())) == [(1, "x,,y")]
    lists = spark.createDataFrame([(1, "1,5"), (1, "2,5")], "key long, value string")
    assert lists.groupBy("key").agg(merges.sort_list()).first()[1] == "1,2,5,5"
    big = spark.createDataFrame([(1, 2**63 - 1), (1, 2**63 - 1), (1, 3)], "key long, value long")
    assert int(big.groupBy("key").agg(merges.uint64_add()).first()[1]) == (2**64 + 1) % 2**64


def test_codecs(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "")], -3, [b"\x01", b"\x03\x02"])], "p array<struct<name:string,value:string>>, x long, l array<binary>")
    r = df.select(codecs.decode_properties(codecs.encode_properties(df.p)), codecs.zigzag(df.x), codecs.unzigzag(codecs.zigzag(df.x)), codecs.bytes_xor(df.l), codecs.node_key(df.x)).first()
    assert [tuple(x) for x in r[0]] == [("a", "1"), ("b", "")] and r[1:3] == (5, -3) and bytes(r[3]) == b"\x02\x02" and bytes(r[4])[0] == 0xFD


def test_agg_merge(spark):
    ops = [(1, 1, "", 2), (1, 2, "sum", 3), (1, 3, "multiply", 4), (2, 1, "sum", 1), (2, 2, "", 1)]
    got = {r.key: (r.value, r.error) for r in aggmerge.agg_merge(spark.createDataFrame(ops, "key long, seq long, func string, value long")).collect()}
    assert got == {1: (20, False), 2: (None, True)}


def test_columns_and_overlay(spark):
    data = [("k", 1, 0, 5, "a"), ("k", 1, 1, 8, None), ("k", 2, 0, 4, "b"), ("k", None, 2, 4, None)]
    got = rows(codecs.merge_columns(spark.createDataFrame(data, "key string, col int, kind int, ts long, value string")))
    assert got == [("k", 1, 1, 8, None)]
    base = spark.createDataFrame([(1, 10), (2, 20)], "key long, value long")
    batch = spark.createDataFrame([(2, 0, None), (3, 1, 30)], "key long, op int, value long")
    assert rows(kv.overlay(base, batch)) == [(1, 10), (3, 30)]
    assert rows(kv.ingest(base, spark.createDataFrame([(1, 5)], "key long, value long"), behind=True)) == [(1, 10), (2, 20)]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("1 2\n2 3\n1 2\nbad\n")
    assert rows(files.read_edge_list(spark, str(tmp_path / "edges.txt"), undirected=True)) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    (tmp_path / "work.txt").write_text("add 1 2\nget 1\n")
    assert [r.verb for r in files.read_workload(spark, str(tmp_path / "work.txt")).orderBy("seq").collect()] == ["add", "get"]
    log = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 2, 0), (3, 5, 6, 1)], "seq long, src long, dst long, op int")
    files.write_sorted(log, str(tmp_path / "log"), "seq")
    stream = logs.live_keys(logs.tail(spark, str(tmp_path / "log"), log.schema), ["src", "dst"])
    logs.run_once(stream, "live", "complete", str(tmp_path / "ck"))
    assert rows(spark.table("live").where("op = 1").select("src", "dst")) == [(5, 6)]
    with pytest.raises(ValueError):
        files.import_disjoint(log, log, "seq")


def test_registry_has_sql_for_known_names():
    from adjalog import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_savepoints_model(spark):
    rng = random.Random(3)
    entries, want = [], []
    for batch in range(20):
        open_, live = [], []
        for i in range(40):
            kind = rng.choice(["write", "write", "write", "set", "rollback", "pop"])
            entries.append((batch, i, kind))
            if kind == "write":
                live.append(i)
            elif kind == "set":
                open_.append(len(live))
            elif open_:
                n = open_.pop()
                live = live[:n] if kind == "rollback" else live
        want += [(batch, i) for i in live]
    got = batches.after_savepoints(spark.createDataFrame(entries, "b int, i int, kind string"), "b", "i", "kind").select("b", "i")
    assert rows(got) == sorted(want, key=str)


def test_skip_until_model(spark):
    rng = random.Random(4)
    data, want = [], []
    for run in range(10):
        end = -1
        for k in range(60):
            u = k + rng.randrange(-2, 9) if rng.random() < 0.3 else None
            data.append((run, k, u))
            if k < end:
                continue
            if u is not None and u > k:
                end = u
            else:
                want.append((run, k))
    got = batches.skip_until(spark.createDataFrame(data, "run int, k int, u int"), "run", "k", F.col("u")).select("run", "k")
    assert rows(got) == sorted(want, key=str)


def test_filters_and_replay(spark):
    log = spark.createDataFrame([(1, 1, "a"), (2, 2, ""), (None, 3, "c"), (3, 4, "d")], "xid long, seq long, value string")
    marks = spark.createDataFrame([(1, "commit", 10), (1, "rollback", 11), (3, "rollback", 9)], "xid long, mark string, mark_seq long")
    assert rows(batches.committed(log, marks).select("value", "seq", "step")) == [("a", 10, 1), ("c", 3, 3)]
    assert batches.remove_empty(log).count() == 3
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "created int, size int")
    assert rows(batches.fifo_drop(sizes, 11)) == [(2, 5), (3, 5)]
    ops = spark.createDataFrame([("k", 1, 1), ("k", 2, 3), ("k", 3, 1)], "key string, seq int, op int")
    assert rows(batches.single_deletes(ops)) == [("k", 3, 1)]


def test_caches(spark):
    keys = [1, 2, 3, 1, 4, 1, 2, 5, 1, 2, 3, 4]
    trace = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "s int, i int, k int")
    got = {r.policy: r.hits for r in caches.simulate(trace, "s", "i", "k", 3).collect()}
    assert got["lru"] == 4 and got["fifo"] == 3 and got["opt"] >= max(got.values())
    assert caches.simulate(trace.where("false"), "s", "i", "k", 3).count() == 0
    assert caches.bucket_limits(200) == [1, 2, 3, 4, 6, 10, 15, 22, 34, 51, 76, 110, 170]
    one = caches.bucket_percentile(trace.withColumn("v", F.lit(7)), "s", "v", 99).first()
    assert (one.n, one.estimate) == (12, 7.0)


def test_text_commands(spark, tmp_path):
    db, out = str(tmp_path / "db"), str(tmp_path / "dump")
    run = lambda *a: cli.main(list(a), spark)
    assert run("put", db, "a", "1") == run("put", db, "b", "2 ==> x") == run("put", db, "c", "3") == ["OK"]
    run("delete", db, "c")
    assert run("get", db, "c") == ["NotFound"] and run("get", db, "a") == ["1"]
    assert run("scan", db) == ["a ==> 1", "b ==> 2 ==> x"] and run("count", db, "--from", "b") == ["1"]
    run("dump", db, out)
    run("load", db + "2", out)
    assert run("scan", db + "2") == run("scan", db)


def test_range_deletes_of_any_width(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([0, 1, 2**20, 2**40, 2**62 - 1]) + rng.randrange(50)
    log = [(i, at()) for i in range(400)]
    dels = [(rng.randrange(400), *sorted((at(), at()))) for _ in range(300)] + [(500, 7, 7), (399, 2**62 - 1, 2**62)]
    want = sorted(((s, k) for s, k in log if not any(lo <= k < hi and d > s for d, lo, hi in dels)), key=str)
    logged, gone = spark.createDataFrame(log, "seq long, key long"), spark.createDataFrame(dels, "seq long, lo long, hi long")
    out = fold.apply_range_deletes(logged, gone)
    assert rows(out) == want and "NestedLoop" not in out._jdf.queryExecution().toString()
    early = sorted(((s, k) for s, k in log if s <= 200 and not any(lo <= k < hi and 200 >= d > s for d, lo, hi in dels)), key=str)
    assert rows(fold.apply_range_deletes(logged, gone, upto_seq=200)) == early
    assert rows(fold.apply_range_deletes(logged, gone.limit(0))) == sorted(log, key=str)
    with pytest.raises(Exception, match="ends before it begins"):
        fold.apply_range_deletes(logged, spark.createDataFrame([(1, 5, 3)], "seq long, lo long, hi long")).collect()


def test_ordered_windows(spark):
    rng = random.Random(6)
    numbers = rng.sample(range(-500, 10**6), 700)
    df = spark.createDataFrame([(x, x % 7) for x in numbers], "x long, size long")
    order = sorted(numbers)
    assert rows(ordered.ranked(df, "x", "r").select("x", "r")) == sorted(((x, i) for i, x in enumerate(order)), key=str)
    sums, total = {}, 0
    for x in order:
        sums[x] = total
        total += x % 7
    assert rows(ordered.running(df, "x", "size", "s").select("x", "s")) == sorted(sums.items(), key=str)
    asked = [(x,) for x in rng.sample(range(-600, 10**6), 300)]
    want = [(x, max((y for y in numbers if y <= x), default=None)) for (x,) in asked]
    assert rows(kv.seek_for_prev(df.select(F.col("x").alias("key")), spark.createDataFrame(asked, "key long"))) == sorted(want, key=str)
    assert ordered.ranked(df.limit(0), "x", "r").count() == 0


def test_get_folds_merge_operands(spark):
    log = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 7), (2, 1, 2, 3), (3, 1, 1, 1), (3, 2, 0, None), (4, 1, 1, 9)], "key long, seq long, op int, value long")
    assert rows(kv.get_latest(log)) == [(1, 7), (2, 3), (4, 9)]
    assert rows(kv.get_latest(log, F.sum("value"))) == [(1, 12), (2, 3), (4, 9)]
    lists = log.withColumn("value", F.col("value").cast("string"))
    assert rows(fold.merge_fold(lists, ["key"], merges.sort_list(), with_base=False)) == [(1, "7"), (2, "3"), (4, "9")]


def test_counters_and_sketches(spark):
    degree = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 31, 32, 100, 1000, 5000])], "id long, degree long")
    got = {r.degree: r.estimate for r in graph.morris_degree(degree).collect()}
    assert all(got[n] == n for n in (0, 1, 31, 32)) and all(n / 2 < got[n] < 2 * n for n in (100, 1000, 5000))
    keys = [i % 40 for i in range(500)] + [99] * 300
    exact = {k: keys.count(k) for k in keys}
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    est = {r.key: r.estimate for r in graph.count_min_estimate(graph.count_min_table(df, 0.3), df, 0.3).collect()}
    assert all(est[k] >= n for k, n in exact.items()) and sum(est.values()) > sum(exact.values())
    r = graph.estimator_accuracy(df, 0.3).first()
    off = [est[k] - n for k, n in exact.items()]
    assert r.most == max(off) and r.mean_error == pytest.approx(sum(off) / len(off)) and r.mean_relative == pytest.approx(sum((est[k] - n) / n for k, n in exact.items()) / len(off))


def test_replay_and_lists(spark):
    lines = [(1, "add", 1, 2), (2, "add", 1, 2), (3, "get", 1, None), (4, "delete", 1, 9), (5, "add", 1, 3), (6, "get", 1, None), (7, "delete", 1, 2), (8, "get", 1, None), (9, "get", 5, None)]
    assert rows(graph.replay(spark.createDataFrame(lines, "seq long, verb string, src long, dst long"))) == [(3, 1, 1), (6, 1, 2), (8, 1, 1), (9, 5, 0)]
    assert graph.sketch_sizes(vertices=10) == {"count_min": 4 * 32620 * 3, "morris": 10}
    loads = graph.power_law_loads(100, 2, 50, 2.5, spark).groupBy("id").count()
    assert loads.count() == 100 and loads.agg(F.min("count"), F.max("count")).first()[0] >= 2


def test_versions_lint_and_rates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "key long, name string")
    files.save_version(df, str(tmp_path), 3)
    assert rows(files.load_version(spark, str(tmp_path), 3)) == rows(df)
    assert files.file_metadata(files.load_version(spark, str(tmp_path), 3)).agg(F.sum("rows")).first()[0] == 3
    assert rows(codecs.property_lint(df)) == [(1,)]
    cols = spark.createDataFrame([(1, 3, 10, 5, "x"), (1, 3, 90, 50, "y"), (1, 0, 1, 0, "z")], "key long, kind int, ts long, ttl long, value string")
    assert rows(codecs.expire_columns(cols, 100).select("kind", "value")) == [(0, "z"), (1, None), (3, "y")]
    assert codecs.expire_columns(cols, 100, purge=True).count() == 2
    assert spark.createDataFrame([(b"\x01" + bytes(7),), (b"xx",)], "b binary").select(codecs.uint64_or_zero(F.col("b"))).collect()[0][0] == 1
    sizes = spark.createDataFrame([(i, 10) for i in range(6)], "created long, size long")
    assert rows(batches.fifo_drop(sizes, 35).select("created")) == [(3,), (4,), (5,)]


def test_graph_store(spark, tmp_path):
    g = graph_log.GraphStore(spark, str(tmp_path))
    assert g.edges().count() == 0 and g.vertices().count() == 0
    g.add_vertices([1, 2, 1])
    g.add_edges([(1, 2), (2, 1), (3, 1), (1, 2)])
    g.set_edge_property(1, 2, "w", "5")
    g.set_vertex_property(1, "name", "a")
    assert rows(g.vertices()) == [(1,), (2,)] and rows(g.edges()) == [(1, 2), (2, 1), (3, 1)]
    assert g.edge_property(1, 2) == [("w", "5")] and g.edge_property(2, 1) == []
    g.add_vertices([1])  # it exists: nothing changes
    g.delete_edges([(2, 1), (7, 8)])
    assert rows(g.edges()) == [(1, 2), (3, 1)] and rows(g.vertex_properties()) == [(1, "name", "a")]
    g.add_vertices([1], strict=True)
    assert rows(g.edges()) == [(3, 1)] and rows(g.edges(inward=True)) == [(1, 2)]
    assert rows(g.vertex_properties()) == [] and rows(g.edge_properties()) == [] and g.vertices().count() == 2
    assert rows(graph_log.edges(g.log(upto_batch=2))) == [(1, 2), (2, 1), (3, 1)]
    again = graph_log.GraphStore(spark, str(tmp_path))
    ops = spark.createDataFrame([("edge", 5, 6, 1), ("unedge", 5, 6, 2), ("edge", 5, 7, 1)], "kind string, src long, dst long, i long")
    assert again.append(ops, F.col("i")) == 8 and rows(g.edges()) == [(3, 1), (5, 7)]


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 7), (3, 2, 1, 4), (4, 2, 0, None), (5, 3, 2, 8)], "seq long, key long, op int, value long")
    said = F.when(F.col("key") == 1, "remove").when(F.col("key") == 3, "change").otherwise("keep")
    assert rows(lifecycle.compaction_filter(log, said, F.lit(0).cast("long")).select("seq", "op", "value")) == [(1, 0, None), (2, 0, None), (3, 1, 4), (4, 0, None), (5, 1, 0)]
    with pytest.raises(Exception, match="unknown decision"):
        lifecycle.compaction_filter(log, F.lit("what"), F.lit(0)).collect()
    with pytest.raises(Exception, match="corrupted record: 3"):
        kv.stop_at(log, F.col("seq") == 4, F.lit(False), F.col("seq") == 3).collect()
    assert kv.stop_at(log, F.col("seq") == 3, F.lit(False), F.col("seq") == 4).count() == 2
    assert rows(lifecycle.merge_checked(log, F.sum("value"), F.col("value") == 7)) == [(1, None, True), (3, 8, False)]
    assert rows(lifecycle.merge_entity(log.withColumn("c", F.col("seq")), F.sum("value"), ["c"])) == [(1, 12, 1), (3, 8, None)]
    marks = spark.createDataFrame([(1, "prepare", 1), (2, "prepare", 1), (2, "commit", 3), (3, "rollback", 2), (3, "commit", 5)], "xid long, mark string, mark_seq long")
    entries = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,)], "xid long")
    assert rows(lifecycle.transaction_states(entries, marks)) == [(0, 1, "started"), (1, 2, "prepared"), (2, 1, "committed"), (3, 1, "rolledback")]
    families = spark.createDataFrame([(1, "create", "a"), (2, "drop", "a"), (3, "create", "b"), (4, "create", "b"), (5, "create", "a"), (6, "drop", "c")], "seq long, verb string, name string")
    assert rows(lifecycle.column_families(families)) == [("a", 5), ("b", 3)]


def test_cache_policies_follow_their_definitions(spark):
    rng = random.Random(9)
    keys = [rng.choice([rng.randrange(6), rng.randrange(60)]) for _ in range(800)]
    trace = spark.createDataFrame([(i, k, 0) for i, k in enumerate(keys)], "i long, key long, shard int")
    hits = {r.policy: r.hits for r in caches.simulate(trace, "shard", "i", "key", 8).collect()}
    assert set(hits) == set(caches.POLICIES) and max(hits.values()) == hits["opt"]
    held, mru = [], 0
    for k in keys:
        if k in held:
            mru += 1
            held.remove(k)
        elif len(held) == 8:
            held.pop()
        held.append(k)
    assert hits["mru"] == mru
    lru = [r for r in caches.miss_ratio_curve(caches.reuse_distances(trace, "shard", "i", "key"), [1, 8, 100]).collect()]
    assert [len(keys) - r.misses for r in lru][1] == hits["lru"] and lru[2].misses == len(set(keys))
    arc = caches.POLICIES["arc"](4)
    for k in [1, 2, 3, 4, 1, 2, *range(100, 140)]:  # a scan does not push out what was met twice
        arc.access(k, 0)
    assert arc.access(1, 0) and arc.access(2, 0)
    for k in keys:
        arc.access(k, 0)
        assert len(arc.once) + len(arc.again) <= 4 and sum(map(len, (arc.once, arc.again, arc.gone_once, arc.gone_again))) <= 8


def test_generators_files_and_events(spark, tmp_path):
    from adjalog.streaming.listeners import EventLog

    g = graph.random_graph(spark, 50, 2000, seed=3)
    assert rows(g) == rows(graph.random_graph(spark, 50, 2000, seed=3)) and g.agg(F.min("src"), F.max("dst")).first()[0] == 0 and g.select("dst").distinct().count() == 50
    mix = {r.verb: r["count"] for r in graph.operation_mix(spark, 20, 4000, {"add": 3, "get": 1}).groupBy("verb").count().collect()}
    assert set(mix) == {"add", "get"} and 2800 < mix["add"] < 3200
    df = spark.createDataFrame([("a1", 1), ("b1", 2), ("a2", 3)], "key string, v int")
    files.write_partitioned(df, str(tmp_path / "parts"), "key", 1)
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert rows(back.select("part", "key")) == [("a", "a1"), ("a", "a2"), ("b", "b1")]
    assert files.check_sorted(back).agg(F.sum("rows"), F.sum("disorder")).first() == (3, 0)
    spark.createDataFrame([(2,), (1,)], "key long").coalesce(1).write.parquet(str(tmp_path / "loose"))
    assert files.check_sorted(spark.read.parquet(str(tmp_path / "loose"))).agg(F.sum("disorder")).first()[0] == 1
    log = EventLog()
    spark.streams.addListener(log)
    try:
        q = logs.run_once(logs.tail(spark, str(tmp_path / "loose"), df.sparkSession.read.parquet(str(tmp_path / "loose")).schema), "seen", "append", str(tmp_path / "ck"))
        for _ in range(100):
            if any(e[0] == "terminated" for e in log.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert log.events[0] == ("started", str(q.id), None) and ("progress", str(q.id), 2) in log.events


def test_more_commands(spark, tmp_path):
    path = str(tmp_path / "t")

    def run(*argv):
        return cli.main(list(argv), spark)

    run("batchput", path, "a", "1", "b", "2", "c", "3", "a", "9")
    assert run("multi_get", path, "c", "x", "a") == ["c ==> 3", "x ==> NotFound", "a ==> 9"]
    assert run("approxsize", path) == ["6"] and run("checkconsistency", path) == ["OK"]
    run("deleterange", path, "a", "c")
    assert run("scan", path) == ["c ==> 3"]
    with pytest.raises(ValueError):
        run("deleterange", path, "c", "a")


def test_saved_versions(spark, tmp_path):
    root = str(tmp_path / "saved")
    assert files.versions(spark, root) == [] and files.purge_versions(spark, root, 1) == []
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "key long, value string")
    marks = {}
    for v in (3, 11, 7):
        marks[v] = files.fingerprint(df.limit(v))
        files.save_version(df.limit(v), root, v)
    assert files.versions(spark, root) == [3, 7, 11] and files.verify_version(spark, root, 7, marks[7])
    assert not files.verify_version(spark, root, 7, files.fingerprint(df.distinct()))
    assert files.purge_versions(spark, root, 2) == [3] and files.versions(spark, root) == [7, 11]
    with pytest.raises(ValueError):
        files.write_sorted(df, str(tmp_path / "s"), strict=True)
    files.write_sorted(df.distinct(), str(tmp_path / "s"), strict=True)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
