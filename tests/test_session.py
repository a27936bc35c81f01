"""Settings and the shared folder."""

import importlib

import pytest

import __spark_entry__
import tiffinlake_oracles as oracles
from tiffinlake import cli, session
from tiffinlake.plans import registry


class Fake:
    """As much of a session as scratch_root looks at."""

    def __init__(self, **conf):
        self.conf = conf


def test_shared_folder_comes_from_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_dir(spark, "x").startswith(f"{shared}/tiffinlake/")
    assert session.scratch_dir(spark, "x") != session.scratch_dir(spark, "x")


def test_scratch_is_below_shared_places_only():
    warehouse = {"spark.sql.warehouse.dir": "hdfs://w/"}
    assert session.scratch_root(Fake(**{"spark.checkpoint.dir": "s3a://shared/"}, **warehouse)) == "s3a://shared"
    assert session.scratch_root(Fake(**warehouse)) == "hdfs://w/_scratch"
    assert not hasattr(session, "tempfile")


@pytest.mark.parametrize("master, refused", [("local", False), ("local[8]", False), ("yarn", True), ("spark://m:7077", True), ("local-cluster[2,1,1024]", True)])
def test_a_warehouse_on_one_machine_is_no_shared_folder(master, refused):
    fake = Fake(**{"spark.sql.warehouse.dir": "file:/w"})
    fake.sparkContext = type("Context", (), {"master": master})
    if refused:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_root(fake)
    else:
        assert session.scratch_root(fake) == "file:/w/_scratch"


def test_a_topic_that_has_gone_is_published_again(spark, small):
    path = registry.raw_topic(spark, small)
    assert registry.raw_topic(spark, small) == path
    session.remove(spark, path)
    again = registry.raw_topic(spark, small)
    assert again != path and session.exists(spark, again)


def test_driver_contract(spark):
    importlib.reload(__spark_entry__)
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(registry.QUERIES) == set(oracles.SQL) <= set(sql) <= set(queries)
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["city", "orders", "revenue", "avg_order_value"]
    assert rows.count() == 10


def test_jobs_from_end_to_end(spark, small, tmp_path, capsys):
    raw, processed, stored = f"{tmp_path}/raw", f"{tmp_path}/processed", f"{tmp_path}/table"

    def run(*argv):
        cli.main(argv, spark)
        return capsys.readouterr().out

    run("publish", "--tables", small, "--output", raw)
    run("enrich", "--input", raw, "--output", processed, "--checkpoint", f"{tmp_path}/c1", "--once")
    run("ingest", "--input", processed, "--table", stored, "--checkpoint", f"{tmp_path}/c2", "--once")
    run("live", "peak", "--input", raw, "--output", f"{tmp_path}/live", "--checkpoint", f"{tmp_path}/c3", "--once")
    assert "940340.03" in run("report", "totals", "--table", stored)
    everything = run("report", "all", "--table", stored)
    assert all(name in everything for name in cli.REPORTS)
    assert "182057.98" in everything
    assert "284" in run("sql", "SELECT SUM(is_peak_hour) AS n FROM food_orders", "--table", stored)
    assert spark.read.parquet(f"{tmp_path}/live").where("is_peak_hour = 1").first()["orders"] == 284
    # All rows go to a folder; the screen says that it holds some of them only.
    text = "SELECT order_id FROM food_orders"
    assert "more than these 20 rows" in run("sql", text, "--table", stored)
    run("sql", text, "--table", stored, "--output", f"{tmp_path}/ids")
    assert spark.read.parquet(f"{tmp_path}/ids").distinct().count() == 1000
    run("report", "all", "--table", stored, "--output", f"{tmp_path}/reports", "--as-of-ms", "1706657176220")
    assert spark.read.parquet(f"{tmp_path}/reports/hours-last-day").groupBy().sum("orders").first()[0] == 41
    assert "created" in run("register", "--table", stored, "--name", "by_command")
    assert "up to date" in run("register", "--table", stored, "--name", "by_command")
    assert spark.table("by_command").count() == 1000
    spark.sql("DROP TABLE by_command")
    assert run("compact", "--table", stored).strip() == "0"
    assert "2024-01-28" in run("expire", "--table", stored, "--as-of-ms", "1706657176220")


def test_options_of_the_streams():
    args = cli.parser().parse_args(
        ["enrich", "--input", "kafka:h:1/t", "--output", "o", "--checkpoint", "c", "--max-offsets", "5",
         "--kafka-option", "kafka.security.protocol=SSL", "--kafka-option", "a=b=c", "--max-bytes", "7"]
    )
    assert cli.kafka_options(args) == {"kafka.security.protocol": "SSL", "a": "b=c"}
    assert (args.max_offsets, args.max_bytes) == (5, 7)


def test_streams_run_until_stopped(spark, monkeypatch):
    """An interrupt ends a job quietly, and its own session with it."""
    stopped = []

    class Session:
        def stop(self):
            stopped.append(True)

    monkeypatch.setattr(cli, "build_session", Session)

    def interrupted(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "stream_from", interrupted)
    cli.main(["enrich", "--input", "a", "--output", "b", "--checkpoint", "c"])
    assert stopped == [True]
