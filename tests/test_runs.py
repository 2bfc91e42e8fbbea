from __future__ import annotations

import glob
import os
from dataclasses import replace

import pyarrow.parquet as pq
import pytest

from shelfcast.__main__ import main
from shelfcast.config import ExportConfig, ForecastConfig
from shelfcast.operators import codes
from shelfcast.plans.export_run import load_predictions, run_export
from shelfcast.plans.forecast_run import open_run, run_forecast
from shelfcast.sources import sinks, storage

CFG = ForecastConfig(
    use_model=False, store_chunk_size=1, chunks_per_commit=1, product_sample_rate=0.34, write_dense=True, write_full=True, write_csv=True
)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark, golden, golden_stores, golden_products, tmp_path_factory):
    folder = tmp_path_factory.mktemp("input")
    paths = {}
    for name, df in (("sales", golden), ("stores", golden_stores), ("products", golden_products)):
        df.write.parquet(f"{folder}/{name}")
        paths[name] = spark.read.parquet(f"{folder}/{name}")
    return paths["sales"], paths["stores"], paths["products"]


@pytest.fixture(scope="module")
def whole(spark, tables, tmp_path_factory):
    return run_forecast(spark, *tables, str(tmp_path_factory.mktemp("whole")), CFG)


def test_whole_run(spark, whole):
    assert whole.complete and whole.chunks_written == 3
    assert whole.predictions.columns == ["internal_store_id", "internal_product_id", "horizon", "prediction"]
    assert whole.predictions.count() == 60
    keys = whole.predictions.select("internal_store_id", "internal_product_id", "horizon").distinct()
    assert keys.count() == 60
    summary = whole.summary.first()
    assert (summary.n_stores, summary.n_products, summary.expected_predictions) == (3, 4, 60)
    assert (summary.extinct_pairs, summary.representative_products) == (1, 1)
    assert (summary.transactions_read, summary.transactions_left_out, summary.stores_done) == (10, 0, 3)
    assert rows_of(spark.read.option("header", True).csv(f"{whole.run_dir}/metrics_csv"))[0][0] == "1"
    csv = spark.read.option("header", True).schema(whole.predictions.schema).csv(f"{whole.run_dir}/full_predictions_csv")
    assert rows_of(csv) == rows_of(whole.predictions)


def test_interrupted_run_goes_on_where_it_stopped(spark, tables, whole, tmp_path):
    first = run_forecast(spark, *tables, str(tmp_path), CFG, max_commits=2)
    assert not first.complete and first.chunks_written == 2
    assert first.predictions.count() == 40 and first.summary.first().stores_done == 2
    stores = spark.read.parquet(f"{first.run_dir}/stores")
    assert rows_of(storage.pending_chunks(spark, first.run_dir, stores)) == [(2,)]
    second = run_forecast(spark, *tables, str(tmp_path), CFG)
    assert second.run_dir == first.run_dir and second.chunks_written == 1
    assert rows_of(second.predictions) == rows_of(whole.predictions)
    third = run_forecast(spark, *tables, str(tmp_path), CFG)
    assert third.chunks_written == 0 and rows_of(third.predictions) == rows_of(whole.predictions)


def test_a_chunk_without_manifest_entry_is_written_again(spark, tables, whole, tmp_path):
    first = run_forecast(spark, *tables, str(tmp_path), CFG, max_commits=1)
    # A batch that broke off before its manifest entry leaves files behind.
    left_over = spark.read.parquet(f"{first.run_dir}/predictions").withColumn("prediction", -1.0 * storage.F.col("horizon"))
    left_over.drop("store_chunk").write.parquet(f"{first.run_dir}/predictions/store_chunk=1")
    assert first.predictions.count() == 20
    assert rows_of(run_forecast(spark, *tables, str(tmp_path), CFG).predictions) == rows_of(whole.predictions)


def test_other_settings_or_inputs_are_another_run(spark, tables, whole, tmp_path):
    other = run_forecast(spark, tables[0], None, None, str(tmp_path), CFG, max_commits=1)
    assert os.path.basename(other.run_dir) != os.path.basename(whole.run_dir)
    layout = run_forecast(spark, *tables, str(tmp_path), replace(CFG, chunks_per_commit=3, write_csv=False), max_commits=1)
    assert os.path.basename(layout.run_dir) == os.path.basename(whole.run_dir)


def test_rows_decide_the_run_whatever_they_are_read_from(spark, tables, whole, tmp_path):
    sales, stores, products = tables
    fewer = run_forecast(spark, sales.where("quantity > 4"), stores, products, str(tmp_path), CFG, max_commits=1)
    assert os.path.basename(fewer.run_dir) != os.path.basename(whole.run_dir)
    in_memory = [spark.createDataFrame(df.collect(), df.schema) for df in tables]
    same = run_forecast(spark, *in_memory, str(tmp_path), CFG, max_commits=1)
    assert os.path.basename(same.run_dir) == os.path.basename(whole.run_dir)
    changed = in_memory[0].withColumn("quantity", in_memory[0]["quantity"] + 1)
    assert run_forecast(spark, changed, *in_memory[1:], str(tmp_path), CFG, max_commits=1).run_dir != same.run_dir
    # Files rewritten under the same name.
    sales.write.parquet(f"{tmp_path}/sales")
    before = run_forecast(spark, spark.read.parquet(f"{tmp_path}/sales"), stores, products, str(tmp_path), CFG, max_commits=1)
    changed.write.mode("overwrite").parquet(f"{tmp_path}/sales")
    after = run_forecast(spark, spark.read.parquet(f"{tmp_path}/sales"), stores, products, str(tmp_path), CFG, max_commits=1)
    assert before.run_dir == same.run_dir != after.run_dir


def test_own_run_id_refuses_other_inputs(spark, tables, tmp_path):
    run_forecast(spark, *tables, str(tmp_path), CFG, run_id="mine", max_commits=1)
    with pytest.raises(ValueError, match="other inputs or settings"):
        run_forecast(spark, tables[0].where("quantity > 4"), *tables[1:], str(tmp_path), CFG, run_id="mine")


def test_a_refresh_computes_changed_chunks_only(spark, tables, tmp_path):
    sales, stores, products = tables
    cfg = replace(CFG, write_full=False, write_csv=False)
    first = run_forecast(spark, *tables, str(tmp_path), cfg, run_id="mine")
    assert first.chunks_written == 3
    before = rows_of(first.predictions)
    # S1's sale of P2 makes an extinct pair; without it only the chunk of S1 has other facts.
    later = sales.where("not (internal_store_id = 'S1' and internal_product_id = 'P2')")
    fresh = run_forecast(spark, later, stores, products, f"{tmp_path}/whole", cfg)
    stopped = run_forecast(spark, later, stores, products, str(tmp_path), cfg, run_id="mine", max_commits=0, refresh=True)
    assert not stopped.complete and stopped.summary.first().stores_done == 2
    again = run_forecast(spark, later, stores, products, str(tmp_path), cfg, run_id="mine", refresh=True)
    assert again.chunks_written == 1 and again.complete
    assert rows_of(again.predictions) == rows_of(fresh.predictions) != before
    back = run_forecast(spark, *tables, str(tmp_path), cfg, run_id="mine", refresh=True)
    assert back.chunks_written == 1 and back.run_dir == first.run_dir and rows_of(back.predictions) == before
    # A store fewer: its chunk is no part of the result, though its files are still there.
    fewer = run_forecast(spark, sales, stores.where("pdv <> 'S3'"), products, str(tmp_path), cfg, run_id="mine", refresh=True)
    assert fewer.predictions.count() == 40
    # A batch that breaks off leaves its chunk withdrawn.
    storage.write_chunks(spark, f"{tmp_path}/mine", [(0, "x")], lambda c: fewer.predictions.selectExpr("0 as store_chunk", "horizon"), 1, 0)
    assert fewer.predictions.count() == 40
    with pytest.raises(RuntimeError):
        storage.write_chunks(spark, f"{tmp_path}/mine", [(0, "x")], broken, 1)
    assert rows_of(storage.committed_chunks(spark, f"{tmp_path}/mine").select("store_chunk")) == [(1,), (2,)]


def broken(chunks):
    raise RuntimeError("lost")


def test_a_compact_run_answers_like_the_dense_one(spark, tables, whole, tmp_path):
    compact = run_forecast(spark, *tables, str(tmp_path), replace(CFG, write_dense=False, write_full=False, write_csv=False))
    assert compact.complete and compact.chunks_written == 0
    assert not {"predictions", "manifest", "full_predictions", "weekly"} & set(os.listdir(compact.run_dir))
    assert rows_of(compact.predictions) == rows_of(whole.predictions)
    asked = spark.createDataFrame([("S2", "P3"), ("S1", "P2"), ("S9", "P1")], "store_id string, product_id string")
    found = rows_of(open_run(spark, compact.run_dir).lookup(asked).select("store_id", "product_id", "horizon", "prediction"))
    assert found == [r for r in rows_of(whole.predictions) if r[:2] in {("S2", "P3"), ("S1", "P2")}]
    tables_ = open_run(spark, compact.run_dir)
    one = run_export(spark, tables_.predictions(), f"{tmp_path}/coded", ExportConfig(), tables_.stores, tables_.products)
    two = run_export(spark, load_predictions(spark, whole.run_dir), f"{tmp_path}/joined")
    assert rows_of(spark.read.parquet(one.path)) == rows_of(spark.read.parquet(two.path))
    assert rows_of(spark.read.parquet(f"{one.path}_stores")) == rows_of(spark.read.parquet(f"{two.path}_stores"))


def test_an_unfinished_run_is_not_exported(spark, tables, tmp_path):
    run = run_forecast(spark, *tables, str(tmp_path), CFG, max_commits=1)
    with pytest.raises(ValueError, match="unfinished"):
        load_predictions(spark, run.run_dir)


def test_export_layout_and_head(spark, whole, tmp_path):
    done = run_export(spark, load_predictions(spark, whole.run_dir), f"{tmp_path}/int", ExportConfig(head_rows=7))
    assert (done.chunks_kept, done.chunks_total, done.codec) == (3, 3, "gzip")
    out = spark.read.parquet(done.path)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == [
        "pdv bigint", "produto bigint", "semana smallint", "quantidade bigint",
    ]
    rows = rows_of(out)
    assert len(rows) == 60 and min(r[3] for r in rows) == 0
    assert {r[0] for r in rows} == {1, 2, 3} and {r[1] for r in rows} == {1, 2, 3, 4}
    assert {r[2] for r in rows if r[:2] == (1, 1)} == {1, 2, 3, 4, 5}
    head = spark.read.parquet(done.head_path)
    assert done.head_path.endswith("_head7") and rows_of(head) == rows[:7]
    assert rows_of(spark.read.parquet(f"{done.path}_stores")) == [("S1", 1), ("S2", 2), ("S3", 3)]


def test_export_replaces_an_earlier_one(spark, whole, tmp_path):
    predictions = load_predictions(spark, whole.run_dir)
    run_export(spark, predictions, f"{tmp_path}/int")
    again = run_export(spark, predictions.where("store_chunk < 2"), f"{tmp_path}/int")
    assert spark.read.parquet(again.path).count() == 40


def test_row_groups_of_the_given_length(spark, tmp_path):
    sinks.write_parquet(spark.range(5000).coalesce(1), f"{tmp_path}/t", "gzip", 1000)
    (file,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000] * 5
    assert meta.row_group(0).column(0).compression == "GZIP"


def test_brotli_falls_back(spark):
    assert sinks.usable_codec(spark, False) == "gzip"
    assert sinks.usable_codec(spark, True) in ("brotli", "gzip")


@pytest.mark.parametrize("cap, kept", [(10, [0]), (59, [0]), (60, [0, 1]), (99, [0, 1]), (100, [0, 1, 2])])
def test_prefix_under_a_cap(spark, cap, kept):
    sizes = spark.createDataFrame([(2, 40), (0, 50), (1, 10)], "store_chunk int, bytes bigint")
    assert rows_of(codes.fitting_prefix(sizes, cap).select("store_chunk")) == [(c,) for c in kept]


@pytest.fixture(scope="module")
def bulky(spark):
    """Twelve chunks whose coded bytes do not compress to nothing."""
    return spark.range(12 * 4000).selectExpr(
        "cast(id div 4000 as int) store_chunk",
        "cast(id div 100 as bigint) store_id",
        "cast(id % 100 as string) product_id",
        "cast(1 as int) horizon",
        "cast(pmod(xxhash64(id), 100000) as double) prediction",
    )


@pytest.mark.parametrize("cap_kib", [1, 60, 100])
def test_size_cap_keeps_the_longest_prefix(spark, bulky, tmp_path, cap_kib):
    done = run_export(spark, bulky, f"{tmp_path}/out", ExportConfig(size_cap_mb=cap_kib / 1024))
    out = spark.read.parquet(done.path)
    assert out.count() == 4000 * done.chunks_kept
    assert out.agg({"pdv": "max"}).first()[0] == 40 * done.chunks_kept
    cap = cap_kib * 1024
    if done.chunks_kept > 1:
        assert done.bytes <= cap
    else:
        assert cap_kib == 1 and done.bytes > cap
    # One chunk more would not have fitted.
    more = bulky.where(f"store_chunk <= {done.chunks_kept}")
    longer = run_export(spark, more, f"{tmp_path}/longer", ExportConfig(size_cap_mb=None))
    assert longer.chunks_kept == done.chunks_kept + 1 and longer.bytes > cap


def test_no_cap_and_several_files(spark, bulky, tmp_path):
    done = run_export(spark, bulky, f"{tmp_path}/out", ExportConfig(size_cap_mb=None, target_file_bytes=50_000))
    files = glob.glob(f"{done.path}/*.parquet")
    assert len(files) > 1 and spark.read.parquet(done.path).count() == 48_000


def test_chunk_files_by_name(spark, golden, tmp_path):
    import pandas as pd

    for i, store in enumerate(["a", "b"]):
        frame = pd.DataFrame(
            {"internal_store_id": [store] * 2, "internal_product_id": ["x", "y"],
             "horizon": pd.array([1, 1], "int16"), "prediction": [0.5, 1.4]}
        )
        frame.to_parquet(f"{tmp_path}/chunk_{i:05d}.parquet", index=False)
    rows = load_predictions(spark, str(tmp_path))
    assert rows_of(rows.select("store_chunk", "store_id", "product_id", "prediction")) == [
        (0, "a", "x", 0.5), (0, "a", "y", 1.4), (1, "b", "x", 0.5), (1, "b", "y", 1.4),
    ]
    files = [f"{tmp_path}/chunk_{i:05d}.parquet" for i in (1, 0, 1)]
    assert rows_of(load_predictions(spark, files).select("store_chunk", "product_id")) == [(0, "x"), (0, "y"), (1, "x"), (1, "y")]
    assert load_predictions(spark, files[:1]).select("store_chunk").distinct().collect() == [(1,)]
    done = run_export(spark, rows, f"{tmp_path}/merged")
    assert rows_of(spark.read.parquet(done.path)) == [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]


def test_missing_chunks_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no such folder"):
        load_predictions(spark, f"{tmp_path}/absent")
    with pytest.raises(FileNotFoundError, match="no chunk_"):
        load_predictions(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="chunk_00007"):
        load_predictions(spark, [f"{tmp_path}/chunk_00007.parquet"])
    with pytest.raises(ValueError, match="without a chunk number"):
        load_predictions(spark, [f"{tmp_path}/part-0.parquet"])
    with pytest.raises(ValueError, match="no files"):
        load_predictions(spark, [])


def test_run_with_models(spark, tmp_path):
    weeks = [f"date_add(date'2024-01-02', {7 * w})" for w in range(30)]
    sales = spark.sql(
        "select concat('s', s) store_id, concat('p', p) sku, explode(array(" + ",".join(weeks) + ")) transaction_date,"
        " cast(s * 10 + p as double) quantity from (select id % 4 s, id div 4 p from range(12))"
    )
    sales.write.parquet(f"{tmp_path}/sales")
    cfg = ForecastConfig(
        min_train_rows=50, boost_rounds=3, early_stop_rounds=2, num_leaves=4, min_leaf_rows=2, learning_rate=0.5, missing_model="base"
    )
    run = run_forecast(spark, spark.read.parquet(f"{tmp_path}/sales"), None, None, f"{tmp_path}/out", cfg)
    summary = run.summary.first()
    assert summary.top_pairs == 12 and [s.skipped for s in summary.splits] == [False] * 5
    assert run.predictions.columns[:2] == ["store_id", "sku"]
    assert run.predictions.count() == 4 * 3 * 5
    again = run_forecast(spark, spark.read.parquet(f"{tmp_path}/sales"), None, None, f"{tmp_path}/out", cfg)
    assert again.chunks_written == 0 and rows_of(again.predictions) == rows_of(run.predictions)


def test_command_line(spark, tables, tmp_path, capsys):
    for name, df in zip(("sales", "stores", "products"), tables):
        df.write.parquet(f"{tmp_path}/{name}")
    inputs = [a for n, t in (("transactions", "sales"), ("stores", "stores"), ("products", "products"))
              for a in (f"--{n}", f"{tmp_path}/{t}")]
    main(["forecast", *inputs, "--out", f"{tmp_path}/out", "--run-id", "r1", "--no-model", "--no-csv"])
    main(["export", "--predictions", f"{tmp_path}/out/r1", "--out", f"{tmp_path}/int", "--head-rows", "5"])
    assert f"{tmp_path}/out/r1" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/int").count() == 60
    assert spark.read.parquet(f"{tmp_path}/int_head5").count() == 5


def test_nothing_to_export(spark, bulky, tmp_path):
    with pytest.raises(ValueError, match="no predictions"):
        run_export(spark, bulky.where("store_chunk < 0"), f"{tmp_path}/none")


def test_many_batches_take_few_jobs(spark, tmp_path):
    built = []

    def build(chunks):
        built.append(len(chunks))
        return spark.createDataFrame([(c, 1.0 * c) for c in chunks], "store_chunk int, prediction double")

    chunks = [(c, f"d{c}") for c in range(50)]
    assert storage.write_chunks(spark, str(tmp_path), chunks, build, 2, max_commits=1, most_chunks=24) == 2
    assert rows_of(storage.committed_chunks(spark, str(tmp_path))) == chunks[:2]
    assert storage.write_chunks(spark, str(tmp_path), chunks[2:], build, 2, most_chunks=24) == 48
    # One batch, four, then as many as the limit allows.
    assert built == [2, 2, 8, 24, 14]
    wanted = spark.createDataFrame(chunks, "store_chunk int, digest string")
    assert rows_of(storage.read_chunks(spark, str(tmp_path), wanted).select("store_chunk")) == [(c,) for c in range(50)]
    # Still an entry for each batch.
    entries = storage.manifest(spark, str(tmp_path)).where("digest is not null").groupBy("entry").count()
    assert entries.count() == 25 and entries.select("count").distinct().first()[0] == 2
