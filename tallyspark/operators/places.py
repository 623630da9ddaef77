"""Cities and delivery routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import total

UNASSIGNED, UNASSIGNED_ROUTE = "UNASSIGNED", "UNASSIGNED_ROUTE"


def active_cities(cities: DataFrame) -> DataFrame:
    return cities.where("active")


def usable_routes(routes: DataFrame, cities: DataFrame) -> DataFrame:
    """Active routes of active cities; routes without a city are out."""
    return routes.where("active").join(active_cities(cities).select("cityId"), "cityId", "left_semi")


def city_keys(cities: DataFrame) -> DataFrame:
    """(key, cityId): a city by its id and by its name, in lower case."""
    return active_cities(cities).select(F.explode(F.array_distinct(F.transform(F.array("cityId", "name"), F.lower))).alias("key"), "cityId").groupBy("key").agg(F.min("cityId").alias("cityId"))


def assigned(rows: DataFrame, cities: DataFrame, routes: DataFrame) -> DataFrame:
    """``rows`` (city, route_id, job_city, job_route) with city_id and delivery_route.

    A city comes from the row by id or name, else from its route, else from the job; a route must belong to the
    city, else the job's route is tried; what is left is unassigned.
    """
    keys, live = city_keys(cities), usable_routes(routes, cities)
    by = lambda name: keys.select(F.col("key").alias(f"_k_{name}"), F.col("cityId").alias(f"_c_{name}"))
    out = rows.join(by("own"), F.lower("city") == F.col("_k_own"), "left")
    route_city = live.groupBy("routeId").agg(F.min("cityId").alias("_c_route")).withColumnRenamed("routeId", "_r")
    out = out.join(route_city, F.col("route_id") == F.col("_r"), "left").join(by("job"), F.lower("job_city") == F.col("_k_job"), "left")
    out = out.withColumn("city_id", F.coalesce("_c_own", "_c_route", "_c_job", F.lit(UNASSIGNED)))
    for name, column in (("own", "route_id"), ("job", "job_route")):
        pair = live.select(F.col("routeId").alias(f"_p_{name}"), F.col("cityId").alias(f"_q_{name}")).distinct()
        out = out.join(pair, (F.col(column) == F.col(f"_p_{name}")) & (F.col("city_id") == F.col(f"_q_{name}")), "left")
    out = out.withColumn("delivery_route", F.coalesce("_p_own", "_p_job", F.lit(UNASSIGNED_ROUTE)))
    return out.select(*rows.columns, "city_id", "delivery_route")


def city_route_totals(rows: DataFrame) -> DataFrame:
    """Totals of each product on each route, of each route, and of each city, in one pass; ``level`` counts the keys that are summed over."""
    sets = rows.groupingSets([("city_id", "delivery_route", "product_key"), ("city_id", "delivery_route"), ("city_id",)], "city_id", "delivery_route", "product_key")
    return sets.agg(total("cases").alias("cases"), total("units").alias("units"), (F.grouping("delivery_route") + F.grouping("product_key")).cast("int").alias("level"))


def unassigned(rows: DataFrame) -> DataFrame:
    """Rows with an unresolved place, and which."""
    issue = F.array_compact(F.array(F.when(F.col("city_id") == UNASSIGNED, "UNRESOLVED_CITY"), F.when(F.col("delivery_route") == UNASSIGNED_ROUTE, "UNRESOLVED_ROUTE")))
    return rows.withColumn("issues", issue).where(F.size("issues") > 0)


def with_route_order(rows: DataFrame, routes: DataFrame) -> DataFrame:
    return rows.join(routes.select(F.col("routeId").alias("delivery_route"), "sortOrder"), "delivery_route", "left")


def route_order() -> list[Column]:
    """Cities, their routes by sort order, routes without one last."""
    return [F.col("city_id").asc(), F.col("sortOrder").asc_nulls_last(), F.col("delivery_route").asc()]


def in_route_order(rows: DataFrame, routes: DataFrame) -> DataFrame:
    return with_route_order(rows, routes).orderBy(*route_order())
