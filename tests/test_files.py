"""Packages, stored tables, providers and streams on small inputs."""

import io
import tempfile
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from altloom.operators import breaker, provider
from altloom.plans.packages import deck_bytes
from altloom.sources import office, tables
from altloom.streaming import jobs


def place():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def element(n, kind, parent=None, **more):
    base = dict(
        uid=n + 1, deck="d", slide_idx=0, shape_idx=n, shape_id=n + 1, parent_id=parent, shape_type=kind, shape_name=f"s{n}", existing_alt="", text="",
        slide_text=f"bytes {n}", slide_notes="a note", width=10, height=20, left=1, top=2, fill_kind="none", has_line=False,
    )
    return base | more


def test_deck_folder(spark):
    root = Path(place())
    deck = pd.DataFrame(
        [element(0, "GROUP"), element(1, "PICTURE", 1, existing_alt="Inner."), element(2, "TEXT_BOX", None, text="one\ntwo"), element(3, "CONNECTOR"), element(4, "CHART")]
    )
    (root / "sub").mkdir()
    (root / "sub" / "a.PPTX").write_bytes(deck_bytes(deck))
    (root / "~$a.pptx").write_bytes(b"lock")
    (root / "bad.pptx").write_bytes(b"no zip")
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as package:
        package.writestr("ppt/slides/s1.xml", "<open>")
    (root / "torn.pptx").write_bytes(broken.getvalue())
    (root / "other.txt").write_text("x")
    files = office.scan_files(spark, str(root))
    assert files.count() == 3
    found, errors = office.deck_elements(files)
    rows = {r["shape_id"]: r for r in found.collect()}
    assert {k: r["shape_type"] for k, r in rows.items()} == {1: "GROUP", 2: "PICTURE", 3: "TEXT_BOX", 4: "CONNECTOR", 5: "CHART"}
    assert rows[1]["existing_alt"] == "Inner." and rows[2]["parent_id"] == 1 and rows[2]["depth"] == 1
    assert rows[3]["slide_text"] == "one\ntwo" and rows[3]["slide_notes"] == "a note"
    assert rows[2]["file_name"] == "image2.png" and rows[2]["has_picture"] and not rows[3]["has_picture"]
    assert sorted(r["error"].split(":")[0] for r in errors.collect()) == ["BadZipFile", "ParseError"]


def test_manifest_last_line_wins_and_bad_lines_are_kept_aside(spark):
    root = Path(place())
    lines = [
        '{"_type": "manifest_header", "schema_version": "2.0.0"}', '{"key": "a", "final_alt": "old"}', "not json", "",
        '{"key": "b", "unknown_field": 1}', '{"key": "a", "final_alt": "new", "current_alt": "was"}',
    ]
    (root / "m.jsonl").write_text("\n".join(lines))
    entries, rejected = tables.read_manifest(spark, str(root))
    rows = [(r["key"], r["final_alt"], r["suggested_alt"], r["existing_alt"], r["had_existing_alt"]) for r in entries.collect()]
    assert rows == [("a", "new", "new", "was", True)]
    assert rejected.count() == 2


def test_no_exchange_carries_packages(spark):
    root = Path(place())
    (root / "a.pptx").write_bytes(b"not a package")
    (root / "~$a.pptx").write_bytes(b"lock")
    files = office.scan_files(spark, str(root))
    plan = office.package_parts(files, office.DECK_PARTS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [r.error[:10] for r in office.package_parts(files, office.DECK_PARTS).collect()] == ["BadZipFile"]
    large = office.package_parts(office.scan_files(spark, str(root), most_bytes=5), office.DECK_PARTS).collect()
    assert [r.error for r in large] == ["FileTooLarge: not read"]


def damaged(content: bytes, member: str) -> bytes:
    """A package whose member cannot be unpacked, while the others can."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        at, size = package.getinfo(member).header_offset + 30 + len(member), min(12, package.getinfo(member).compress_size)
    return content[:at] + b"\xff" * size + content[at + size :]


def test_bad_members_and_numbers_are_error_rows(spark):
    shapes = [element(0, "PICTURE", text=""), element(1, "TEXT_BOX", text="kept " * 50), element(2, "TEXT_BOX", text="also")]
    good = deck_bytes(pd.DataFrame(shapes))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as changed:
        for name in package.namelist():
            data = package.read(name)
            if name == "ppt/slides/s9.xml":
                data = data.replace(b'id="2"', b'id="two"').replace(b'x="9525"', b'x="1e3"', 1).replace(b'id="3"', b"")
            changed.writestr(name, data)
    files = spark.createDataFrame(
        [("good", good), ("numbers", out.getvalue()), ("media", damaged(good, "ppt/media/image1.png")), ("slide", damaged(good, "ppt/slides/s9.xml"))],
        "path string, content binary",
    )
    found, errors = office.deck_elements(files)
    rows = sorted(((r.deck, r.z_order, r.shape_id, r.left_px, r.has_picture) for r in found.collect()), key=repr)
    assert [r for r in rows if r[0] == "good"] == [("good", 0, 1, 1, True), ("good", 1, 2, 1, False), ("good", 2, 3, 1, False)]
    assert [r for r in rows if r[0] == "numbers"] == [("numbers", 0, 1, 0, True), ("numbers", 1, -2, 1, False), ("numbers", 2, -3, 1, False)]
    assert [r for r in rows if r[0] == "media"] == [("media", 0, 1, 1, False), ("media", 1, 2, 1, False), ("media", 2, 3, 1, False)]
    assert not [r for r in rows if r[0] == "slide"]
    told = sorted((r.deck, r.part, r.error.split(":")[0]) for r in errors.collect())
    assert [t[:2] for t in told] == [("media", "ppt/media/image1.png"), ("numbers", "ppt/slides/s9.xml"), ("numbers", "ppt/slides/s9.xml"), ("slide", "ppt/slides/s9.xml")]
    assert [t[2] for t in told if t[0] == "numbers"] == ["BadNumber", "BadNumber"]


def test_facts_need_no_exchange_and_may_stream(spark):
    root = Path(place())
    (root / "a.pptx").write_bytes(deck_bytes(pd.DataFrame([element(0, "PICTURE"), element(1, "TEXT_BOX", text="x")])))
    read = office.shown_elements(office.package_facts(office.scan_files(spark, str(root)), office.DECK_PARTS))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    stream = office.shown_elements(office.package_facts(jobs.stream_files(spark, str(root)), office.DECK_PARTS))
    name = f"shown_{root.name.replace('-', '_')}"
    stream.select("deck", "shape_id", "content_key").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, read.select("deck", "shape_id", "content_key").collect()))


def test_pictures_of_charts_and_relations(spark):
    rel = '<Relationships>{}</Relationships>'
    link = lambda name, target: f'<Relationship Id="{name}" Target="{target}"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("ppt/presentation.xml", '<p xmlns:r="x"><sldId id="1" r:id="rId1"/></p>')
        package.writestr("ppt/_rels/presentation.xml.rels", rel.format(link("rId1", "slides/slide1.xml")))
        package.writestr("ppt/slides/slide1.xml", "<sld><spTree/></sld>")
        package.writestr("ppt/slides/_rels/slide1.xml.rels", rel.format(link("rId2", "../charts/chart1.xml") + link("rId3", "../media/loose.png")))
        package.writestr("ppt/charts/_rels/chart1.xml.rels", rel.format(link("rId1", "../media/bars.png")))
        package.writestr("ppt/media/loose.png", b"loose")
        package.writestr("ppt/media/bars.png", b"bars")
    files = spark.createDataFrame([("a.pptx", out.getvalue())], "path string, content binary")
    found = office.linked_pictures(files).select("slide_idx", "chart", "file_name").collect()
    assert sorted(map(repr, map(tuple, found))) == ["(0, 'ppt/charts/chart1.xml', 'bars.png')", "(0, None, 'loose.png')"]


def test_recorded_chains(spark):
    rows = [("a", n, n == 2) for n in range(9)] + [("b", n, False) for n in range(5)] + [("c", 0, False)] + [("d", n, n > 3) for n in range(6)]
    calls = spark.createDataFrame([(k, n, f"p{n}", ok, 1.0) for k, n, ok in rows], "key string, n int, provider string, success boolean, cost double")
    found = {r.key: (r.provider, r.status, r.attempts, r.cut) for r in provider.recorded_chain(calls, "key", ["n"], 3).collect()}
    assert found == {"a": ("p2", "ok", 3, False), "b": (None, "fail", 3, True), "c": (None, "fail", 1, False), "d": (None, "fail", 3, True)}


def test_final_map_forms(spark):
    root = Path(place())
    (root / "m.json").write_text('{"k1": "  plain ", "k2": {"existing_alt": " e ", "final_alt": "", "source_generated": "x"}, "k3": ""}')
    rows = {r["key"]: r for r in tables.import_old_map(spark, str(root)).collect()}
    assert (rows["k1"]["generated_alt"], rows["k1"]["final_alt"], rows["k1"]["source_existing"]) == ("plain", "plain", "pptx")
    assert (rows["k2"]["existing_alt"], rows["k2"]["final_alt"], rows["k2"]["source_generated"]) == ("e", None, "x")
    assert rows["k3"]["final_alt"] is None


def test_maps_and_manifests_keep_every_deck(spark):
    rows = [(d, f"k{n}", f"{d} {n}") for d in ("a", "b") for n in range(3)]
    root = place()
    tables.write_json_map(spark.createDataFrame(rows, "deck string, key string, v string"), "key", F.col("v"), "deck", f"{root}/map")
    found = tables.read_alt_map(spark, f"{root}/map").select("deck", "key", "final_alt").collect()
    assert sorted(map(tuple, found)) == rows
    entries = spark.createDataFrame([(d, k, f"i{k}", v) for d, k, v in rows], "deck string, key string, instance_key string, final_alt string")
    same_key = entries.withColumn("key", F.lit("one"))
    for number, written in enumerate((entries, same_key)):
        tables.write_manifest(written, f"{root}/m{number}", by="deck")
        read, rejected = tables.read_manifest(spark, f"{root}/m{number}")
        assert sorted((r.deck, r.final_alt) for r in read.collect()) == [(d, v) for d, _, v in rows] and rejected.count() == 0


def test_missing_and_corrupt_caches_are_empty(spark):
    root = Path(place())
    assert tables.read_alt_cache(spark, str(root / "none")).count() == 0
    (root / "c.json").write_text("{broken")
    assert tables.read_alt_cache(spark, str(root)).count() == 0


def test_one_call_per_content(spark):
    asked = spark.createDataFrame([(f"c{n % 3}", f"{n % 3}abc", "p") for n in range(30)], "content_key string, image_hash string, prompt string")

    def bad():
        def call(image, prompt):
            raise ValueError("down")
        return call

    def good():
        return lambda image, prompt: {"status": "ok", "text": image} if image[0] != "2" else {}

    results = provider.generate_chain(asked, [("bad", bad), ("good", good)])
    assert {(r["content_key"], r["text"], r["status"]) for r in results.collect()} == {("c0", "0abc", "ok"), ("c1", "1abc", "ok"), ("c2", None, "fail")}
    assert provider.attempt_rows(results).count() == 6
    assert provider.generate_chain(asked, [("bad", bad)] * 5).selectExpr("max(size(attempts))").first()[0] == 3


def test_breaker_script(spark):
    script = [(False, t) for t in range(5)] + [(True, 10), (True, 70), (False, 71), (True, 140), (True, 141)]
    rows = [("p", datetime(2024, 1, 1) + timedelta(seconds=at), n, ok) for n, (ok, at) in enumerate(script)]
    found = breaker.breaker_changes(spark.createDataFrame(rows, "provider string, ts timestamp, attempt_id bigint, success boolean"), 5, 60.0, 2)
    told = {r.attempt_id: r.state for r in found.collect()}
    assert [told.get(n) for n in range(10)] == [None, None, None, None, "open", None, "half_open", "open", "half_open", "closed"]


def test_breaker_stream_keeps_state_between_files(spark):
    source, out, state = place(), place(), place()
    start = datetime(2024, 1, 1)
    rows = [(n, start + timedelta(seconds=n), "p", False) for n in range(4)]
    schema = "attempt_id bigint, ts timestamp, provider string, success boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        read = spark.readStream.schema(schema).parquet(source)
        jobs.stream_breaker(read, out, state, threshold=5).awaitTermination()

    run()
    spark.createDataFrame([(4, start + timedelta(seconds=4), "p", False)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert [(r["attempt_id"], r["state"]) for r in spark.read.parquet(out).collect()] == [(4, "open")]


def test_ledger_stream_resumes(spark):
    source, out, state = place(), place(), place()
    schema = "path string, status string, updated_at timestamp"
    clock = [datetime(2024, 1, 1) + timedelta(hours=n) for n in range(3)]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_ledger(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
        return {r["path"]: r["status"] for r in jobs.newest_version(spark, out).collect()}

    assert run([("a", "pending", clock[0]), ("b", "pending", clock[0])]) == {"a": "pending", "b": "pending"}
    assert run([("a", "complete", clock[2]), ("a", "processing", clock[1])]) == {"a": "complete", "b": "pending"}


def test_stage_overwrite_touches_one_stage(spark):
    root = place()
    one, two = (spark.createDataFrame([(k,)], "key string") for k in ("x", "y"))
    tables.write_stage(one, root, "current", "r")
    tables.write_stage(two, root, "final", "r")
    tables.write_stage(two, root, "current", "r")
    assert [r["key"] for s in ("current", "final") for r in tables.read_stage(spark, root, s, "r").collect()] == ["y", "y"]


def test_late_rows_are_dropped_and_state_is_released(spark):
    source, out, state = place(), place() + "/out", place()
    days = [datetime(2024, 1, d, h) for d, h in ((1, 0), (5, 0), (6, 0), (1, 6), (20, 0))]
    schema = "ts timestamp, cost double"
    for number, day in enumerate(days):
        spark.createDataFrame([(day, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.write_each(jobs.stream_budget(read, 0.5, "1 hour"), out, state).awaitTermination()
    found = sorted((r.day.day, r.daily_cost) for r in spark.read.parquet(out).collect())
    assert found == [(1, 1.0), (5, 1.0), (6, 1.0)]  # the row of the fourth file came too late, the last day is still open


def test_ledger_without_its_last_version_is_an_error(spark):
    source, out, state = place(), place(), place()
    schema = "path string, status string, updated_at timestamp"
    at = datetime(2024, 1, 1)

    def fold(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_ledger(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()

    fold([("a", "processing", at), ("a", "complete", at), ("b", "pending", at)])
    assert sorted((r.path, r.status) for r in jobs.newest_version(spark, out).collect()) == [("a", "complete"), ("b", "pending")]
    (Path(out) / "commits" / "version=0").rename(Path(place()) / "gone")
    try:
        fold([("c", "pending", at)])
    except Exception as problem:
        assert "version=0" in str(problem)
    else:
        raise AssertionError("a lost version went unnoticed")


def test_ledger_rewrites_only_touched_buckets(spark):
    source, out, state = place(), place(), place()
    schema = "path string, status string, updated_at timestamp"
    at = datetime(2024, 1, 1)
    batches = [[(f"p{n}", "pending", at) for n in range(200)], [("p7", "complete", at + timedelta(hours=1))], [("p8", "failed", at + timedelta(hours=2))], [("p9", "complete", at)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_ledger(spark.readStream.schema(schema).parquet(source), out, state, buckets=16).awaitTermination()
    written = [sorted(p.name for p in (Path(out) / "data" / f"version={v}").glob("bucket=*")) for v in range(4)]
    assert len(written[0]) >= 13 and [len(w) for w in written[1:]] == [1, 1, 1]
    assert jobs.commits(spark, out) == [2, 3]
    used = {(b, v) for c in (2, 3) for b, v in jobs.versions(spark, out, c).items()}
    assert {(int(b.removeprefix("bucket=")), v) for v, names in enumerate(written) for b in names} == used
    found = {r.path: r.status for r in jobs.newest_version(spark, out).collect()}
    assert len(found) == 200 and (found["p7"], found["p8"], found["p9"], found["p10"]) == ("complete", "failed", "complete", "pending")


def test_decks_share_files(spark):
    rows = [(f"deck_{n % 200}", f"k{n}", "t") for n in range(1000)]
    df, root = spark.createDataFrame(rows, "deck string, key string, v string").repartition(4), place()
    tables.write_json_map(df, "key", F.col("v"), "deck", f"{root}/map")
    tables.write_coverage(df.groupBy("deck").count(), f"{root}/coverage")
    assert len(list(Path(root, "map").rglob("part-*"))) <= 4
    assert len(list(Path(root, "coverage").rglob("part-*"))) <= 8
    assert sorted(map(tuple, tables.read_json_map(spark, f"{root}/map").select("deck", "key", "value").collect())) == sorted(rows)
    assert spark.read.schema("count bigint, deck string").json(f"{root}/coverage").agg(F.count("deck"), F.sum("count")).first() == (200, 1000)


def test_maps_in_a_folder_per_deck_are_still_read(spark):
    root = place()
    lines = spark.createDataFrame([("a", '{"key": "k", "value": "1"}'), ("b", '{"key": "k", "value": "2"}')], "deck string, value string")
    lines.write.partitionBy("deck").text(f"{root}/map")
    assert sorted((r.deck, r.key, r.value) for r in tables.read_json_map(spark, f"{root}/map").collect()) == [("a", "k", "1"), ("b", "k", "2")]
