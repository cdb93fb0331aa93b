"""Jobs of tenants, and relational tables in parts."""

import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from gradus.jobs import TenantJobs
from gradus.sources import readers


def test_a_tenants_jobs_run_in_order_and_tenants_at_once(spark):
    jobs, log, lock = TenantJobs(spark, at_once=2), [], threading.Lock()
    both = threading.Barrier(2, timeout=20)

    def work(tenant, n):
        with lock:
            log.append(("start", tenant, n))
        if n == 0:
            both.wait()  # ends only if the other tenant runs too
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        total = spark.range(n + 1).agg(F.count("*")).first()[0]
        with lock:
            log.append(("end", tenant, n))
        if n == 1:
            raise KeyError(tenant)
        return pool, total

    futures = {(t, n): jobs.submit(t, work, t, n) for n in range(3) for t in ("one", "two")}
    jobs.close()
    for t in ("one", "two"):
        assert [(what, n) for what, tenant, n in log if tenant == t] == [(w, n) for n in range(3) for w in ("start", "end")]
        assert futures[t, 0].result() == (t, 1) and futures[t, 2].result() == (t, 3)
        assert isinstance(futures[t, 1].exception(), KeyError)
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_cancelling_a_tenant(spark):
    jobs, begun = TenantJobs(spark), threading.Event()

    def slow():
        begun.set()
        return spark.range(40, numPartitions=40).select(F.udf(lambda x: time.sleep(1) or x, "long")("id").alias("x")).agg(F.sum("x")).first()

    running, waiting, other = jobs.submit("a", slow), jobs.submit("a", slow), jobs.submit("b", lambda: 7)
    assert begun.wait(20)
    time.sleep(1)
    assert jobs.cancel("a") == 1 and other.result(20) == 7
    assert running.exception(30) is not None and waiting.cancelled()
    jobs.close()


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(100).select((F.col("id") * 3 - 50).cast("int").alias("K"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("NAME"))
    rows = rows.unionByName(spark.createDataFrame([(None, "no key"), (10_000, "far")], "K int, NAME string"))
    rows.coalesce(1).write.jdbc(url, "ITEMS", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    return url


@pytest.mark.parametrize("options", [{}, {"parts": 1}, {"parts": 3, "bounds": (0, 100)}, {"parts": 50, "bounds": (5, 8)}, {"bounds": (7, 7)}])
def test_every_row_is_read_once(spark, database, options):
    made = readers.relational_parts(spark, database, "ITEMS", "K", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", **options)
    assert sorted((r.K is None, r.K or 0, r.NAME) for r in made.collect()) == sorted([(False, i * 3 - 50, f"name {i}") for i in range(100)] + [(True, 0, "no key"), (False, 10_000, "far")])


def test_parts_filters_and_one_row(spark, database):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    made = readers.relational_parts(spark, database, "ITEMS", "K", parts=4, bounds=(-50, 250), driver=driver)
    assert made.rdd.getNumPartitions() == 4
    plan = made.where("K > 200").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(K,200)" in plan
    assert readers.relational(spark, database, "SELECT NAME FROM ITEMS WHERE K = 10000", driver=driver).first().NAME == "far"
