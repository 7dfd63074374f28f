"""Migration of both tables: counts, a second run, a dry run, and crashes between the writes."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallyforge.sources import migration

def at():
    return F.lit("2026-06-15 10:00:00").cast("timestamp")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Clients.csv").write_text("business_name,ein,entity_type,city_state_zip\nBlue Sky,1,LLC,X\nHarbor Grill,2,,Y\n  ,3,,\nBlue Sky,9,LLC,X\n")
    (tmp_path / "in" / "RevenueRequests.csv").write_text(
        "request_id,business_name,request_type,period,status,amount_due,due_date,bank_statement_received,sales_report_received\n"
        "1,Blue Sky,A,2026-01,Pending,$10.50,1/5/2026,yes,\n2,Nobody,A,2026-01,Pending,5,2026-01-06,,\nx,Blue Sky,A,2026-01,Pending,5,2026-01-06,,\n3,Harbor Grill,B,2026-02,Paid,7,2026-02-06,,y\n"
    )
    return str(tmp_path / "in"), str(tmp_path / "tables")


def test_migrate_twice(spark, folder):
    source, root = folder
    assert migration.manifest(spark, root) == {}
    dry = migration.migrate(spark, source, root, at(), dry_run=True)
    assert (dry.clients, dry.requests, dry.version) == (3, 4, None) and migration.manifest(spark, root) == {}
    first = migration.migrate(spark, source, root, at())
    assert (first.created, first.updated, first.upserted, first.skipped, first.clients_after, first.requests_after, first.version) == (2, 0, 2, 2, 2, 2, 1)
    assert first.reasons == ["None: invalid request id (Blue Sky)", "2: unknown client (Nobody)"]
    ids = {r["business_name"]: r["client_id"] for r in migration.current(spark, root, "clients").collect()}
    (open_,) = migration.current(spark, root, "requests").filter("request_id = '1'").collect()
    assert (open_["client_id"], open_["amount_due"], str(open_["due_date"]), open_["bank_statement_received"], open_["is_deleted"], open_["updated_by"]) == (ids["Blue Sky"], 10.5, "2026-01-05", True, False, "migration")
    second = migration.migrate(spark, source, root, at())
    assert (second.created, second.updated, second.upserted, second.version) == (0, 2, 2, 2)
    assert {r["business_name"]: r["client_id"] for r in migration.current(spark, root, "clients").collect()} == ids


@pytest.mark.parametrize("dies_at", [1, 2, 3])
def test_a_crash_leaves_both_old_versions(spark, folder, monkeypatch, dies_at):
    source, root = folder
    old = spark.range(3).toDF("id")
    migration.publish(spark, root, {"clients": old, "requests": old})
    done, write, text = [], DataFrameWriter.parquet, DataFrameWriter.text

    def dying(plain):
        def run(self, path, *args, **more):
            done.append(path)
            if len(done) == dies_at:
                raise RuntimeError("lost")
            return plain(self, path, *args, **more)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", dying(write))
    monkeypatch.setattr(DataFrameWriter, "text", dying(text))
    new = spark.range(9).toDF("id")
    with pytest.raises(RuntimeError):
        migration.publish(spark, root, {"clients": new, "requests": new})
    assert [migration.current(spark, root, t).count() for t in ("clients", "requests")] == [3, 3]
    monkeypatch.undo()
    assert migration.publish(spark, root, {"clients": new}) == 2
    assert [migration.current(spark, root, t).count() for t in ("clients", "requests")] == [9, 3]


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    migration.publish(spark, root, {"kept": spark.range(1)})
    for i in range(migration.VERSIONS + 2):
        assert migration.publish(spark, root, {"clients": spark.range(i)}) == i + 2
    assert migration.current(spark, root, "clients").count() == migration.VERSIONS + 1 and migration.current(spark, root, "kept").count() == 1
    assert len(list((tmp_path / "t" / "data").glob("clients-*"))) == migration.VERSIONS
    assert migration.current(spark, root, "other", "a int").count() == 0
