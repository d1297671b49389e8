import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from folioscore import schemas
from folioscore.operators import manifest as M, rules, subset as S
from folioscore.operators.fingerprints import inventory_digest, ordered_digest, table_difference, table_fingerprint
from folioscore.operators.ordering import global_position, hash_bucket, neighbours, position_within, running_sums
from folioscore.plans.dataset import make_manifest
from folioscore.sources import scans, sinks


def samples(spark, writers, each):
    rows = [(f"s{w}-{i}", f"w{w}") for w in range(writers) for i in range(each)]
    return spark.createDataFrame(rows, "sample_id string, writer_id string")


@pytest.mark.parametrize(
    ("total", "ratios", "want"),
    [(9, (0.7, 0.15, 0.15), (6, 2, 1)), (3, (0.7, 0.15, 0.15), (1, 1, 1)), (10, (0.8, 0.2, 0.0), (8, 2, 0)), (20, (0.7, 0.15, 0.15), (14, 3, 3))],
)
def test_allocation(spark, total, ratios, want):
    table = M.allocation_table(samples(spark, total, 1), ratios).collect()
    assert tuple({r["split"]: r["count"] for r in table}[s] for s in ("train", "validation", "test")) == want


def test_writer_split_is_isolated_total_and_stable(spark):
    df = samples(spark, 9, 3)
    split = M.assign_writer_split(df, 123)
    counts = {r["split"]: (r["samples"], r["writers"]) for r in M.split_counts(split).collect()}
    assert counts == {"train": (18, 6), "validation": (6, 2), "test": (3, 1)}
    assert M.leaking_writers(split).isEmpty()
    again = M.assign_writer_split(df.repartition(3), 123)
    assert table_difference(split, again).isEmpty()
    with pytest.raises(rules.InvalidRows):
        M.require_writer_sizes(samples(spark, 9, 2), 3)


def test_subset_follows_a_plain_selection(spark):
    seed, rows = "7", []
    for w in range(6):
        for i in range(8 if w else 200):
            rows.append((f"{w:04d}-{i:03d}", f"{w:04d}", i % 3 == 0, "text"))
    df = spark.createDataFrame(rows, "sample_id string, writer_id string, marked boolean, reference string")
    rank = lambda domain, v: hashlib.sha256(f"{domain}\0{seed}\0{v}".encode()).hexdigest()
    want = set()
    for writer in sorted({r[1] for r in rows}, key=lambda w: rank("writer", w))[:4]:
        own = [r for r in rows if r[1] == writer]
        clean = sorted((r[0] for r in own if not r[2]), key=lambda s: rank("clean", s))[:2]
        marked = sorted((r[0] for r in own if r[2]), key=lambda s: rank("marked", s))[:1]
        rest = sorted((r[0] for r in own if r[0] not in {*clean, *marked}), key=lambda s: rank("remaining", s))[:2]
        want |= {*clean, *marked, *rest}
    got = S.stratified_subset(df, seed, writers=4, per_writer=5, clean=2, marked=1)
    assert {r["sample_id"] for r in got.collect()} == want


def test_bucketed_order_equals_plain_order(spark):
    rows = [(g, (i * 7919) % 1000, i) for g in "ab" for i in range(300 if g == "a" else 20)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    bucket = F.floor(F.col("o") / 50)
    order = [F.col("o"), F.col("v")]
    placed = position_within(df, ["g"], order, bucket).collect()
    summed = running_sums(df, ["g"], order, bucket, {"s": "v"}).collect()
    near = neighbours(df, ["g"], order, bucket, previous={"p": "v"}, following={"n": "v"}).collect()
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        key = lambda r: (r["o"], r["v"])
        assert [r["position"] for r in sorted((r for r in placed if r["g"] == g), key=key)] == list(range(1, len(want) + 1))
        total, sums = 0, []
        for r in want:
            total += r[2]
            sums.append(total)
        assert [r["s"] for r in sorted((r for r in summed if r["g"] == g), key=key)] == sums
        values = [r[2] for r in want]
        ordered = sorted((r for r in near if r["g"] == g), key=key)
        assert [r["p"] for r in ordered] == [None, *values[:-1]]
        assert [r["n"] for r in ordered] == [*values[1:], None]


def test_global_position(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(100)).alias("a"), "id").repartition(5)
    got = global_position(df, [F.col("a").desc(), F.col("id")]).collect()
    want = sorted(range(1000), key=lambda i: (-((i * 7919) % 100), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, 1001))


def test_hash_bucket_keeps_the_order(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = position_within(df, [], [F.col("h")], hash_bucket(F.col("h"), 2)).collect()
    assert [r["h"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["h"] for r in rows)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    print_of = lambda d: table_fingerprint(d, F.concat_ws("|", "k", "v")).head()["fingerprint"]
    assert print_of(df) == print_of(df.orderBy(F.col("k").desc()).repartition(3))
    assert print_of(df) != print_of(df.distinct())
    assert print_of(df) != print_of(df.withColumn("v", F.col("v") + 1))


def test_scans_and_manifest_over_files(spark, tmp_path):
    images, labels = tmp_path / "images", tmp_path / "labels.csv"
    images.mkdir()
    lines = ["filename,text,writer_id,slices"]
    for w in range(6):
        for i in range(2):
            (images / f"w{w}-{i}.pgm").write_bytes(b"P5\n1 1\n255\n" + bytes([w]))
            lines.append(f'w{w}-{i}.pgm,"text, {w} ""{i}""",writer {w},faint_pencil|cursive|faint_pencil')
    labels.write_text("\n".join(lines) + "\n")
    identity = M.DatasetIdentity("set", "v1", "CC-BY-4.0", "https://example.org/l")
    metadata = make_manifest(spark, str(labels), str(images), identity, str(tmp_path / "out"), min_samples=2).head()
    assert metadata["num_samples"] == 12 and metadata["duplicate_source_hashes"] == 6
    read = scans.manifest_records(spark, str(tmp_path / "out" / "manifest"))
    assert rules.require_valid(read).count() == 12
    row = read.filter("image_path = 'images/w0-0.pgm'").head()
    assert row["slices"] == ["cursive", "faint_pencil"] and row["reference"] == 'text, 0 "0"'
    assert row["source_sha256"] == hashlib.sha256((images / "w0-0.pgm").read_bytes()).hexdigest()
    assert row["writer_id"] == hashlib.sha256(b"set\0v1\0writer 0").hexdigest()
    assert read.filter(F.col("writer_id").contains("writer")).isEmpty()
    raw = spark.read.text(str(tmp_path / "out" / "manifest")).orderBy(F.get_json_object("value", "$.sample_id"))
    keys = raw.select(F.json_object_keys("value")).head()[0]
    assert keys == sorted(keys)


def test_bad_label_files(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("filename,text\na.png,x\n")
    with pytest.raises(rules.InvalidRows):
        scans.label_rows(spark, str(path))
    wrong = tmp_path / "protected.csv"
    wrong.write_text("filename,writer_id,text,slices,age_band,document_type,capture_type\na,b,c,d,e,f,g\n")
    with pytest.raises(Exception, match="(?i)header"):
        scans.protected_label_rows(spark, str(wrong)).collect()


def test_strict_prediction_scan(spark, tmp_path):
    sha = "a" * 64
    good = f'{{"sample_id":"1","source_sha256":"{sha}","reference":"","prediction":"x","confidence":0.5}}'
    lines = [good, "", "[1]", "{broken", good.replace("0.5", '"high"'), good.replace("0.5", "1.5"), good.replace(sha, "b")]
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n")
    errors = [r["errors"] for r in scans.prediction_records(spark, str(tmp_path / "p.jsonl")).collect()]
    assert len(errors) == 6
    assert errors[0] == []
    assert all("json" in e for e in errors[1:4])
    assert errors[4] == ["confidence"] and errors[5] == ["source_sha256"]


def test_frozen_table_is_written_once_and_drift_is_seen(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, reference string")
    path = str(tmp_path / "frozen")
    sinks.freeze(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.freeze(df, path)
    frozen = spark.read.parquet(path)
    sinks.verify_frozen(frozen, df)
    with pytest.raises(rules.InvalidRows):
        sinks.verify_frozen(frozen, df.withColumn("reference", F.lit("z")))


def test_rows_of_a_frozen_table_meet_by_digests_and_drift_is_listed(spark):
    schema = "sample_id string, reference string, n double, tags array<string>"
    rows = [("a", None, 0.0, ["x"]), (None, "a", 0.0, ["x"]), ("b", "null", 1.0, None), ("b", "null", 1.0, None), ("c", 'd","e', -0.0, [])]
    other = [("a", None, -0.0, ["x"]), (None, "a", 0.0, ["y"]), ("b", "null", 1.0, None), ('c","d', "e", 0.0, []), ("b", None, 1.0, None)]
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    wanted = sorted(map(str, table_difference(left, right).collect()))
    assert len(wanted) == 6 and sorted(map(str, sinks.frozen_problems(left, right).collect())) == wanted
    same = sinks.frozen_problems(left, left)
    assert same.columns == [*left.columns, "surplus"] and same.collect() == []
    # No whole row is dealt out when nothing differs.
    assert "Exchange hash" not in same._jdf.queryExecution().executedPlan().toString()


def test_inventory_digest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"b.json": b"{}", "sub/a.bin": b"123"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    digest = hashlib.sha256()
    for name in sorted(files):
        sha = hashlib.sha256(files[name]).hexdigest()
        digest.update(f'{{"path":"{name}","sha256":"{sha}","size_bytes":{len(files[name])}}}\n'.encode())
    row = inventory_digest(scans.inventory(spark, str(tmp_path))).head()
    assert row["model_artifact_sha256"] == digest.hexdigest()
    assert (row["num_files"], row["total_bytes"]) == (2, 5)


def test_streamed_hashes_equal_loaded_ones(spark, tmp_path):
    contents = {"small": b"1", "sub/large one": bytes(range(256)) * 90_000}
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    for limit in (10, 1 << 30):
        rows = {r["filename"]: r for r in scans.file_hashes(spark, str(tmp_path), in_memory_bytes=limit).collect()}
        for name, content in contents.items():
            row = rows[name.split("/")[-1]]
            assert (row["sha256"], row["md5"], row["size_bytes"]) == (hashlib.sha256(content).hexdigest(), hashlib.md5(content).hexdigest(), len(content))


def test_a_file_above_a_gibibyte_is_hashed(spark, tmp_path):
    size = (1 << 30) + 5
    with open(tmp_path / "weights.bin", "wb") as out:
        out.truncate(size)
    digest = hashlib.sha256()
    for _ in range(1 << 7):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    row = scans.file_hashes(spark, str(tmp_path)).head()
    assert row["sha256"] == digest.hexdigest() and row["size_bytes"] == size


def test_the_digest_takes_any_number_of_rows(spark):
    df = spark.range(150_000).selectExpr("lpad(id, 7, '0') AS sample_id")
    digest = hashlib.sha256()
    for i in range(150_000):
        digest.update(f"{i:07d}\n".encode())
    row = ordered_digest(df.repartition(5), ["sample_id"], F.col("sample_id")).head()
    assert (row["n_rows"], row["sha256"]) == (150_000, digest.hexdigest())
    assert ordered_digest(df.limit(0), ["sample_id"], F.col("sample_id")).head()["sha256"] == hashlib.sha256(b"").hexdigest()


def test_too_few_writers_for_a_split(spark):
    with pytest.raises(Exception, match="too few writers"):
        M.allocation_table(samples(spark, 2, 1), (0.7, 0.15, 0.15)).collect()


def test_completeness_and_duplicates(spark):
    rows = [("1", 0.5, None), ("1", 0.6, 2.0)]
    df = spark.createDataFrame(rows, "sample_id string, confidence double, latency_ms double")
    got = {r["field"]: r["complete"] for r in rules.optional_completeness(df, ["confidence", "latency_ms"]).collect()}
    assert got == {"confidence": True, "latency_ms": False}
    assert rules.duplicate_keys(df, "sample_id").head()["n"] == 2


def test_schema_constants_cover_the_columns():
    names = [f.strip().split()[0] for f in schemas.LEDGER_EVENT.split(",")]
    from folioscore import vocab

    assert names == vocab.EVENT_COLUMNS
    assert not [k for k, g in groupby(sorted(names)) if len(list(g)) > 1]
