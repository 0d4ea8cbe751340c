import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamspark.functions import steim, text
from beamspark.operators import audit, match, model
from beamspark.sources import readers, sinks
from beamspark.streaming import blocks

QUAKEML = """<?xml version="1.0"?><q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2">
<eventParameters><event publicID="smi:e1"><description><text>S0235b</text></description><description><text>other</text></description>
<preferredOriginID>o2</preferredOriginID>
<origin publicID="o1"><time><value>2019-07-26T12:00:00.5Z</value></time></origin>
<origin publicID="o2"><time><value>2019-07-26T12:10:00Z</value></time><arrival><pickID>p2</pickID><phase>P</phase></arrival></origin>
<pick publicID="p1"><phaseHint>p</phaseHint><time><value>2019-07-26T12:11:00Z</value></time><waveformID networkCode="XB" stationCode="ELYSE"/></pick>
<pick publicID="p2"><phaseHint>P</phaseHint><time><value>2019-07-26T12:12:00Z</value></time><waveformID networkCode="XB" stationCode="ELYSE" channelCode="BHU"/></pick>
</event><event publicID="smi:e2"/></eventParameters></q:quakeml>"""


def test_event_table(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "index,event_id,quality,origin_time,distance_deg,distance_err,baz_deg,set\n"
        "1,S0235b,A,2019-07-26T12:19:18Z,28.3,,74.0,vespagram\n2,S1222a,A,2022-05-04T23:23:07.5Z,37.0,1.6,,validation\n")
    r = readers.event_table(spark, str(tmp_path / "e.csv")).collect()
    assert r[0]["distance_err"] is None and r[1]["baz_deg"] is None and r[1]["distance_err"] == 1.6
    assert r[0]["origin_time"].isoformat() == "2019-07-26T12:19:18"


def test_quakeml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(QUAKEML)
    rows = {r["resource_id"]: r for r in readers.quakeml(spark, str(tmp_path / "c.xml")).collect()}
    e = rows["smi:e1"]
    assert e["descriptions"] == ["S0235b", "other"] and len(e["origins"]) == 2 and len(e["picks"]) == 2
    assert e["origins"][1]["arrivals"][0]["pick_id"] == "p2" and e["picks"][1]["waveform_id"]["channel_code"] == "BHU"
    assert rows["smi:e2"]["origins"] == [] and rows["smi:e2"]["picks"] == []


def test_preferred_pick_wins_over_earlier(spark):
    p = spark.createDataFrame([(1, "p1", 10, False), (1, "p2", 20, True), (2, "q2", 7, False), (2, "q1", 5, False)],
                              "k int, pick_id string, at int, preferred boolean")
    got = {r["k"]: r for r in match.select_picks(p, "k").collect()}
    assert got[1]["pick_id"] == "p2" and got[1]["pick_selected_from_preferred_origin_arrival"]
    assert got[2]["pick_id"] == "q1" and got[2]["candidate_p_pick_count"] == 2


def test_layered_model_round_trip(spark, tmp_path):
    (tmp_path / "m.nd").write_text("0.0 5.0 2.9 2.9\n50.0  7.5\t4.2 3.4\nouter-core\n1700 4.9 0 5.9\n2700 5.6 0 6.3\ninner-core\n2700 7 4 6.5\n3389.5 7.1 4.1 6.5\n")
    m = readers.layered_models(spark, str(tmp_path / "m.nd")).orderBy("ord").collect()
    assert [r["section"] for r in m] == ["mantle"] * 2 + ["outer-core"] * 2 + ["inner-core"] * 2
    assert m[1]["vp"] == 7.5 and m[5]["depth"] == 3389.5
    line = spark.createDataFrame([(1.0, 2.0, 3.0, 4.00004)], "a double, b double, c double, d double")
    assert line.select(model.format_rows(*[F.col(c) for c in "abcd"])).first()[0] == "1.0000 2.0000 3.0000 4.0000"


def test_generated_model_refuses_and_builds(spark):
    base = {"mantle": [(0, 5, 2.9, 2.9), (1000, 9, 4.9, 3.7), (1700, 9.8, 5.3, 4.1)],
            "outer-core": [(1700, 4.9, 0, 5.9), (2700, 5.6, 0, 6.3)], "inner-core": [(2700, 7, 4, 6.5), (3389.5, 7.1, 4.1, 6.5)]}
    p = spark.createDataFrame([(1, 1800.0, 4.9, 5.5, 600.0, 0.3), (2, 1800.0, 4.9, 5.5, 1900.0, 0.3), (3, 1800.0, 5.0, 5.0, 600.0, 0.0),
                               (4, 1800.0, -1.0, 5.0, 600.0, 0.0)],
                              "k int, r_oc double, vp_cmb double, vp_icb double, r_ic double, dvp_icb double")
    with pytest.raises(ValueError, match="shear speed"):
        model.generate(p, "k", {**base, "mantle": [(0, 2.0, 3.0, 3.3)]})
    g = model.generate(p, "k", base).toPandas()
    assert g[g.k == 2].status.tolist() == ["radius_order"] and g[g.k == 4].status.tolist() == ["nonpositive_velocity"]
    one = g[g.k == 1]
    assert (one.section == "outer-core").sum() == 15 and (one.section == "inner-core").sum() == 5
    oc = one[one.section == "outer-core"].sort_values("node")
    assert oc.depth.iloc[0] == pytest.approx(1589.5) and oc.depth.iloc[-1] == pytest.approx(2789.5) and (oc.vs == 0).all()
    np.testing.assert_allclose(oc.vp, np.linspace(4.9, 5.5, 15))
    flat = g[(g.k == 3) & (g.section == "outer-core")].sort_values("node")
    np.testing.assert_allclose(flat.depth, np.linspace(1589.5, 2789.5, 15))


def test_manifest_defaults_and_last_digest_wins(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"created_at": "x", "items": [
        {"type": "a", "path": "p", "sha256": "1"}, {"type": "a", "path": "p", "sha256": "2"}, {"type": "a", "path": "p"}]}))
    (tmp_path / "empty.json").write_text(json.dumps({"created_at": "y"}))
    m = readers.manifest(spark, str(tmp_path / "m.json"))
    assert audit.manifest_digests(m).first()["pinned_sha256"] == "2"
    assert readers.manifest(spark, str(tmp_path / "empty.json")).count() == 0


def test_registry_object_or_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"branch": "alpha"}, {"branch": "pi"}]}')
    (tmp_path / "b.json").write_text('[{"branch": "beta"}]')
    rows = readers.registry_rows(spark, str(tmp_path))
    assert sorted(r["row"]["branch"] for r in rows.collect()) == ["alpha", "beta", "pi"]


def test_geojson_top_rows(spark, tmp_path):
    f = [{"id": str(i), "properties": {"mag": 5 + i % 3, "time": 100 - i, "place": "x"}, "geometry": {"coordinates": [1, 2, 3]}} for i in range(9)]
    (tmp_path / "g.json").write_text(json.dumps({"features": f}))
    g = readers.geojson_events(spark, str(tmp_path / "g.json"))
    top = match.top_rows(g, 3, F.col("mag").desc(), F.col("time_ms")).collect()
    assert [r["id"] for r in top] == ["8", "5", "2"] and top[0]["depth_km"] == 3.0


def test_binary_sources(spark, tmp_path):
    np.savez(tmp_path / "a.npz", v=np.arange(6.0).reshape(2, 3), label=np.array("x"))
    np.savez(tmp_path / "a_sub.npz", v=np.zeros(1))
    np.save(tmp_path / "b.npy", np.array([True, False]))
    got = {(r["name"], tuple(r["shape"])): r["values"] for r in readers.npz_arrays(spark, str(tmp_path)).collect()}
    assert got == {("v", (2, 3)): [0, 1, 2, 3, 4, 5], ("", (2,)): [1.0, 0.0]}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.nd", "1 2 3 4")
    m = readers.zip_members(spark, str(tmp_path)).first()
    assert m["member"] == "d/one.nd" and bytes(m["content"]) == b"1 2 3 4"
    inv = readers.inventory(spark, str(tmp_path), "*.npy").first()
    import hashlib
    assert inv["sha256"] == hashlib.sha256((tmp_path / "b.npy").read_bytes()).hexdigest()


def miniseed(values, channel=b"BHU", rate=20):
    h = bytearray(64)
    h[0:8] = b"000001D "
    h[8:20] = b"ELYSE02" + channel + b"XB"
    h[20:30] = struct.pack(">HHBBBxH", 2019, 207, 12, 0, 1, 5000)
    h[30:36] = struct.pack(">Hhh", len(values), rate, 1)
    h[39] = 1
    h[44:48] = struct.pack(">HH", 64, 48)
    h[48:56] = struct.pack(">HHBBBx", 1000, 0, 4, 1, 9)
    return bytes(h) + np.asarray(values, ">f4").tobytes().ljust(448, b"\0")


def test_miniseed(spark, tmp_path):
    (tmp_path / "x.mseed").write_bytes(miniseed([1.5, -2.0, 3.0]) + miniseed([7.0], b"BHV"))
    rows = readers.miniseed_records(spark, str(tmp_path)).orderBy("channel").collect()
    assert [(r["network"], r["station"], r["location"], r["channel"]) for r in rows] == [("XB", "ELYSE", "02", "BHU"), ("XB", "ELYSE", "02", "BHV")]
    assert rows[0]["x"] == [1.5, -2.0, 3.0] and rows[0]["sampling_rate"] == 20.0
    assert np.datetime64(rows[0]["start_us"], "us") == np.datetime64("2019-07-26T12:00:01.5")


def packed(values, second):
    """A record's frames: differences in the widest layout that holds them, for both schemes."""
    x = np.asarray(values, np.int64)
    d = np.diff(x, prepend=x[:1])
    words, codes, i = [], [], 0
    kinds = [(7, 4, 3, 2), (6, 5, 3, 1), (5, 6, 3, 0), (4, 8, 1, None), (3, 10, 2, 3), (2, 15, 2, 2), (1, 30, 2, 1)] if second else [(4, 8, 1, None), (2, 16, 2, None), (1, 32, 3, None)]
    while i < len(d):
        for n, bits, code, top in kinds:
            part = d[i:i + n]
            if len(part) == n and all(-(1 << (bits - 1)) <= v < 1 << (bits - 1) for v in part):
                word = sum((int(v) & ((1 << bits) - 1)) << (bits * (n - 1 - k)) for k, v in enumerate(part))
                words.append(word | ((top or 0) << 30))
                codes.append(code)
                i += n
                break
    out, at = b"", 0
    while at < len(words):
        room = 13 if not out else 15
        w, c = words[at:at + room], codes[at:at + room]
        head = [int(x[0]) & 0xFFFFFFFF, int(x[-1]) & 0xFFFFFFFF] if not out else []
        w, c = (head + w + [0] * 15)[:15], ([0] * len(head) + c + [0] * 15)[:15]
        out += struct.pack(">16I", sum(v << (2 * (14 - k)) for k, v in enumerate(c)), *w)
        at += room
    return out


@pytest.mark.parametrize("encoding", [steim.STEIM1, steim.STEIM2])
def test_compressed_miniseed(spark, tmp_path, encoding):
    rng = np.random.default_rng(3)
    wide = np.cumsum(rng.integers(-3, 4, 60)).tolist() + np.cumsum(rng.choice([1, 30, 200, 9000, 2_000_000], 40) * rng.choice([-1, 1], 40)).tolist()
    record = bytearray(miniseed([0.0] * len(wide)))
    frames = packed(wide, encoding == steim.STEIM2)
    assert len(frames) <= 960
    record[52] = encoding
    record[54] = 10  # records of 1024 bytes
    (tmp_path / "c.mseed").write_bytes(bytes(record[:64]) + frames.ljust(960, b"\0"))
    got = readers.miniseed_records(spark, str(tmp_path)).first()
    assert got["x"] == [float(v) for v in wide] and got["encoding"] == encoding
    with pytest.raises(ValueError, match="last sample"):
        steim.decode(frames[:8] + b"\0\0\0\1" + frames[12:], len(wide), encoding)
    with pytest.raises(ValueError, match="samples"):
        steim.decode(frames, 5000, encoding)


def test_other_encodings_fail_loudly(spark, tmp_path):
    record = bytearray(miniseed([1.0]))
    record[52] = 30
    (tmp_path / "o.mseed").write_bytes(bytes(record))
    with pytest.raises(Exception, match="encoding 30"):
        readers.miniseed_records(spark, str(tmp_path)).collect()
    assert readers.miniseed_records(spark, str(tmp_path), samples=False).first()["encoding"] == 30


def test_stats_files(spark, tmp_path):
    for folder in ("nulls/n1", "real"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "s.csv").write_text("phase,v\nPcP,1\n")
    assert sorted(r["null_type"] for r in readers.stats_files(spark, str(tmp_path), "phase string, v double").collect()) == ["n1", "real"]


def test_lane_sink_prunes(spark, tmp_path):
    g = spark.createDataFrame([("A", 0, [1.0]), ("A", 1, [2.0]), ("B", 0, [3.0])], "variant string, si int, power array<double>")
    sinks.write_lanes(g, str(tmp_path / "v"), ["variant"])
    back = readers.lane_tables(spark, str(tmp_path / "v"))
    one = back.where("variant = 'A' AND si = 1")
    assert one.first()["power"] == [2.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan and "PushedFilters: [IsNotNull(si)" in plan


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.5)], "status string, power double")
    sinks.write_csv(df, str(tmp_path / "c"), sinks.PEAK_COLUMNS)
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert len(sinks.PEAK_COLUMNS) == 36 and back.columns == list(sinks.PEAK_COLUMNS) and back.first()["power"] == "1.5"
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"power":1.5,"status":"x"}'
    sinks.append_manifest(df, str(tmp_path / "m"))
    sinks.append_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    md = [r["line"] for r in sinks.markdown_rows(df).orderBy("place").collect()]
    assert md == ["| status | power |", "| --- | --- |", "| x | 1.5 |"]
    sinks.write_bootstrap(str(tmp_path / "b"), occupancy=df, peaks=df, design=df, meta=df)
    assert spark.read.parquet(str(tmp_path / "b/run_meta")).count() == 1


def test_model_text_sink(spark, tmp_path):
    rows = [("m1", 0, None, 1.0, 2.0, 3.0, 4.0), ("m1", 1, "outer-core", None, None, None, None), ("m1", 2, None, 5.0, 6.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "model string, ord int, mark string, depth double, vp double, vs double, rho double")
    sinks.write_model_text(df, str(tmp_path / "m"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m") + "/model=m1").collect()]
    assert lines == ["1.0000 2.0000 3.0000 4.0000", "outer-core", "5.0000 6.0000 0.0000 7.0000"]


def test_locked_digest_ignores_row_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "k int, c string")
    one = {r["k"]: r["digest"] for r in sinks.locked_digest(a, "k", F.col("c")).collect()}
    two = {r["k"]: r["digest"] for r in sinks.locked_digest(a.orderBy(F.desc("c")).repartition(3), "k", F.col("c")).collect()}
    dropped = {r["k"]: r["digest"] for r in sinks.locked_digest(a.distinct(), "k", F.col("c")).collect()}
    assert one == two and dropped[1] != one[1] and dropped[2] == one[2]


def test_reserved_status_is_refused(spark):
    ok = spark.createDataFrame([("ucla_unverified",)], "s string").select(sinks.refuse_reserved_status(F.col("s")).alias("s"))
    assert ok.first()["s"] == "ucla_unverified"
    bad = spark.createDataFrame([("mps_ucla_verified",)], "s string").select(sinks.refuse_reserved_status(F.col("s")))
    with pytest.raises(Exception, match="reserved status"):
        bad.collect()


def test_text_helpers(spark):
    d = spark.createDataFrame([("S0235b, xS0001a S0002a_ S0003a S0003a",)], "t string")
    assert d.select(text.event_tokens(F.col("t"))).first()[0] == ["S0235b", "S0003a", "S0003a"]
    s = spark.createDataFrame([("identity,2-4, 9,3",)], "s string")
    assert s.select(text.expand_spec(F.col("s"))).first()[0] == [0, 2, 3, 4, 9]
    p = spark.createDataFrame([("m/env/A/nth_root_win20.npz",), ("pws_40.npz",), ("a/../b",), ("/x",), (" ",)], "p string")
    lane = text.lane_path(F.col("p"))
    r = p.select(*[c.alias(n) for n, c in lane.items()]).collect()
    assert tuple(r[0]) == ("m", "env", "A", "nth_root", 20.0) and (r[1]["stack_method"], r[1]["power_window_s"]) == ("pws", 40.0)
    assert [x[0] for x in p.select(text.is_safe_relative(F.col("p"))).collect()] == [True, True, False, False, False]
    v = spark.createDataFrame([("20", "20.0"), (" a ", "a"), ("nan", "x")], "a string, b string")
    assert [x[0] for x in v.select(text.lane_value(F.col("a")) == text.lane_value(F.col("b"))).collect()] == [True, True, False]
    line = spark.createDataFrame([("| `a` | b c | 3 |",)], "l string")
    assert line.select(text.table_cells(F.col("l"))).first()[0] == ["a", "b c", "3"]


def test_nan_is_kept_out_of_comparisons(spark):
    """NaN compares as larger than any number here, so missing values enter as null."""
    d = spark.createDataFrame([(float("nan"),), (2.0,), (float("inf"),)], "v double")
    assert d.where("v >= 1.0").count() == 3
    assert [r[0] for r in d.select(text.finite(F.col("v"))).collect()] == [None, 2.0, None]


def test_deglitch_states(spark):
    rows = [("failed", "", False, False), ("succeeded", "", False, False), ("succeeded", "failed", True, True),
            ("succeeded", "succeeded", True, True), ("succeeded", "succeeded", True, False), ("succeeded", "succeeded", False, True)]
    d = spark.createDataFrame(rows, "t string, r string, a boolean, e boolean")
    st = audit.deglitch_status(F.col("t"), F.col("r"), F.col("a"), F.col("e"))
    assert [r[0] for r in d.select(st).collect()] == [
        "blocked_missing_seisglitch", "succeeded_mps_only", "ucla_unverified", "mps_ucla_verified",
        "sidecar_attested_not_independently_verified", "ucla_unverified"]


def test_hash_chain_adverse(spark):
    l0 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, sha256 string")
    l1 = spark.createDataFrame([(1, "d", "a"), (2, "e", "x")], "k int, sha256 string, upstream_sha256 string")
    got = {r["k"]: (r["first_broken_level"], r["status"]) for r in audit.hash_chain([l0, l1], "k").collect()}
    assert got == {1: (None, "current"), 2: (1, "blocked_stale_provenance"), 3: (1, "blocked_stale_provenance")}


def test_streaming_blocks_and_manifest(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{i // 2}.{5 * (i % 2)}", float(i)) for i in range(10)] + [("a", "2024-01-01 00:01:00", 0.0)]
    df = spark.createDataFrame(rows, "key string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = blocks.block_rms(stream, "key", late="1 second").writeStream.format("memory").queryName("rms").outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination(60)
    got = {r["start"].second: r["rms"] for r in spark.table("rms").collect()}
    assert got[2] == pytest.approx(np.sqrt((16 + 25) / 2)) and len(got) == 5
    m = blocks.append_manifest(stream.select("key", "x"), str(tmp_path / "out"), str(tmp_path / "ck"))
    m.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 11


def test_locked_digest_shuffles_small_keys_once(spark, monkeypatch):
    """Rows move by their key alone, and a key with most of the rows has the digest that the same steps give it."""
    import hashlib
    import re

    a = spark.createDataFrame([(k, f"{k}|{i % 40}") for k in (1, 2, None) for i in range(60 if k == 1 else 5)], "k int, c string").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def expected(texts):
        level = {sha(t): sha(f"{sha(t)}:{texts.count(t)}") for t in texts}
        for width in (6, 3, 0):
            level = {p: sha("".join(level[h] for h in sorted(level) if h.startswith(p))) for p in {h[:width] for h in level}}
        return level[""]

    rows = a.collect()
    want = {k: expected([r["c"] for r in rows if r["k"] == k]) for k in (1, 2, None)}
    d = sinks.locked_digest(a, "k", F.col("c"))
    got = {r["k"]: r["digest"] for r in d.collect()}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(", plan.split("== Initial Plan ==")[-1])) == 1
    monkeypatch.setattr(sinks, "LARGE_DIGEST", 20)
    cut = {r["k"]: r["digest"] for r in sinks.locked_digest(a, "k", F.col("c")).collect()}
    assert got == cut == want
