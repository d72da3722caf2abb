"""Observations of entities whose number is large."""

from datetime import datetime


def test_observations_of_many_entities(spark, tmp_path):
    """Codes of entities above 20,504, where the product of the entity is no integer any more, and below."""
    from obsframe.plans.catalog import CUSTOMERS_PER_ENTITY, Tables

    customers = [0, 20_504 * CUSTOMERS_PER_ENTITY, 20_505 * CUSTOMERS_PER_ENTITY, 108_000 * CUSTOMERS_PER_ENTITY + 7]
    rows = [(10_000_000 + i, c, datetime(1998, 1, 1 + i)) for i, c in enumerate(customers)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.obs_id: r for r in Tables(spark, str(tmp_path)).obs.collect()}
    for key, customer, _ in rows:
        entity = customer // CUSTOMERS_PER_ENTITY
        code = f"{(key * 7919 + entity * 104729) % 100_000_000:08d}"
        assert got[key].entity_id == entity and got[key].head + got[key].pair + got[key].tail == code
        assert [got[key][f"p{i}"] for i in range(1, 9)] == [int(x) for x in code]
