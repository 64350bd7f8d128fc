"""What jobs work out once for many requests."""

from frames import values
from pyspark.sql import functions as F

from turnstile.plans import packages
from turnstile.queries.availability import slot_requests
from turnstile.queries.base import AS_OF, Tables
from turnstile.sources import sinks
from turnstile.sources.derived import DerivedCatalog


def plan(df):
    return df._jdf.queryExecution().toString()


def test_packages_are_priced_before_requests_meet_them(spark, sf):
    t = Tables(spark, sf)
    found = packages.packages(DerivedCatalog(spark, sf), slot_requests(t), AS_OF)
    assert "lambda" not in plan(found)
    assert found.count() > 0


def test_package_documents_form_shared_parts_once(spark, sf):
    t = Tables(spark, sf)
    # One request has no id and no park, another no park: both are answered, the one without an id with no children.
    odd = spark.createDataFrame([(None, None, None), (-5, 3, None), (None, 3, 4)], "request_id long, cookie_id long, park_id long")
    some = slot_requests(t).filter("request_id % 7 = 0")
    odd = odd.join(some.select("date", "product_level_id", "accessible", "use_percent").orderBy("date", "use_percent", "accessible", "product_level_id").limit(1))
    requests = sinks.materialise(some.unionByName(odd))
    cat = DerivedCatalog(spark, sf)
    names = lambda rows: F.array_join(F.transform(rows, lambda r: r["Name"]), ";")
    whole = packages.package_documents(cat, requests, AS_OF).select("request_id", names("Bundles").alias("b"), names("Attractions").alias("a"))
    formed = packages.package_documents(cat, requests, AS_OF, bundles=names, attractions_as=names)
    assert "lambda" not in plan(formed)
    rows = values(formed, "request_id", "Bundles", "Attractions")
    assert rows == values(whole, "request_id", "b", "a") and len(rows) == requests.count()
    assert rows.count((None, None, None)) == 2 and (-5, None, None) in rows and any(b for _, b, _ in rows)
