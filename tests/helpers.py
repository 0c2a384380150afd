"""Build small marketplace tables from Python rows."""

from __future__ import annotations

import datetime as dt

from marketlens.sources import schemas
from marketlens.sources.tables import MarketTables

D = dt.date


def make_tables(
    spark,
    orders=(),
    customers=(),
    items=(),
    payments=(),
    reviews=(),
    products=(),
    sellers=(),
    geolocation=(),
) -> MarketTables:
    def mk(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return MarketTables(
        orders=mk(orders, schemas.ORDERS),
        customers=mk(customers, schemas.CUSTOMERS),
        items=mk(items, schemas.ORDER_ITEMS),
        payments=mk(payments, schemas.PAYMENTS),
        reviews=mk(reviews, schemas.REVIEWS),
        products=mk(products, schemas.PRODUCTS),
        sellers=mk(sellers, schemas.SELLERS),
        geolocation=mk(geolocation, schemas.GEOLOCATION),
    )


def order(oid, cid, status="delivered", purchase=D(2017, 1, 1), approved=None, est=None):
    return (oid, cid, status, purchase, approved, est or purchase)


def item(oid, n=1, pid="p1", sid="s1", price=10.0, freight=1.0):
    return (oid, n, pid, sid, None, price, freight)


def rows(df):
    return [r.asDict() for r in df.collect()]


def plan_nodes(df, reused=False):
    """Nodes of the executed plan, after a run, top down. A shared exchange is
    gone into where it is computed, and where it is read again only if ``reused``."""
    df.collect()
    return list(_walk(df._jdf.queryExecution().executedPlan(), reused))


def _walk(node, reused):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan(), reused)
    elif kind.endswith("QueryStageExec"):
        yield from _walk(node.plan(), reused)
    elif kind == "ReusedExchangeExec":
        if reused:
            yield from _walk(node.child(), reused)
    else:
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from _walk(children.apply(i), reused)


def below(node, reused=True):
    return list(_walk(node, reused))[1:]


def kind_of(node):
    return node.getClass().getSimpleName()


def reads(node, table):
    return any(kind_of(n) == "FileSourceScanExec" and f"/{table}.parquet" in n.toString() for n in below(node))


def rows_out(node):
    return node.metrics().apply("numOutputRows").value()
