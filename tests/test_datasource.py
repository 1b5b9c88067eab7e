"""The data source of facts: what filters leave out is never read, and rows are the bridge's."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tesserae.sources import bridge, datasource, shop

DATA = "/root/testdata/sf0.001"


def edge_rows(df):
    return sorted((tuple(r) for r in df.select("src_id", "dst_id", "dst_desc", "relation").collect()), key=str)


def tables(reader):
    return sorted({(reader.rules()[p.rule].table, reader.rules()[p.rule].label) for p in reader.partitions()})


def test_filters_choose_the_files():
    reader = datasource.FactReader({"path": DATA})
    rest = list(reader.pushFilters([EqualTo(("relation",), "EXTENDS"), GreaterThan(("src_id",), "a"), EqualTo(("dst_id",), "web.customer.7")]))
    assert rest == [GreaterThan(("src_id",), "a"), EqualTo(("dst_id",), "web.customer.7")]
    assert tables(reader) == [("customer", "EXTENDS")]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted(i for b in batches for i in b.column("src_id").to_pylist()) == ["web.customer.14", "web.customer.15"]
    reader = datasource.FactReader({"path": DATA})
    list(reader.pushFilters([In(("src_id",), ("geo.nation.3", "store.supplier.1"))]))
    assert tables(reader) == [("lineitem", "CALL"), ("nation", "MEMBER_OF"), ("supplier", "CONFIGURES")]
    reader = datasource.FactReader({"path": DATA, "facts": "nodes"})
    list(reader.pushFilters([In(("type",), ("VIEW", "DATA")), EqualTo(("type",), "VIEW")]))
    assert tables(reader) == [("pages", "VIEW")]
    for nothing in (EqualTo(("id",), "geo.region.x"), EqualTo(("id",), "geo.region.007"), EqualTo(("type",), "SCRIPT")):
        reader = datasource.FactReader({"path": DATA, "facts": "nodes"})
        list(reader.pushFilters([nothing]))
        assert reader.partitions() == []


def test_rows_are_the_bridge_s(spark):
    want = bridge.edges(spark, DATA)
    assert edge_rows(datasource.read(spark, DATA)) == edge_rows(want)
    for hold in (F.col("relation") == "EXTENDS", F.col("src_id") == "app.order.7", F.col("dst_id").isin("store.supplier.3", "nowhere"), (F.col("relation") == "CALL") & F.col("src_id").startswith("web.") & (F.col("dst_id") == "store.supplier.3"), F.col("relation") == "READS", F.col("src_id") == "web.customer.70", F.col("dst_id").isNull()):
        assert edge_rows(datasource.read(spark, DATA).where(hold)) == edge_rows(want.where(hold))


def test_splits_by_row_groups(spark, tmp_path):
    spark.read.parquet(f"{DATA}/orders.parquet").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "orders.parquet"))
    rules = (), (shop.EDGES[0],)
    shop.ONLY_ORDERS = rules
    try:
        reader = datasource.FactReader({"path": f"file://{tmp_path}", "rules": "tesserae.sources.shop:ONLY_ORDERS", "split_bytes": "1"})
        parts = reader.partitions()
        assert len({p.file for p in parts}) == 3 and all(len(p.groups) == 1 for p in parts)
        assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1500
    finally:
        del shop.ONLY_ORDERS


def test_options_are_checked(spark):
    with pytest.raises(ValueError):
        datasource.FactReader({"path": " "})
    with pytest.raises(ValueError):
        datasource.FactReader({"path": DATA, "facts": "both"})
    with pytest.raises(FileNotFoundError):
        datasource.FactReader({"path": "/root/testdata"}).partitions()
