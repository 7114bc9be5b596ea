"""Queries over SQL texts: statements composed from every order's keys, so that what they hold is known in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlmeta as m
from ..functions import sqltext as q
from .data import Registered, table


def _n(column: str, modulus: int):
    return (F.col(column) % modulus).cast("int")


def _each(n, text):
    """text(1), ... text(n); nothing for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), text)).otherwise(F.array().cast("array<string>"))


def _text(i, before: str, after: str = ""):
    return F.concat(F.lit(before), i.cast("string"), F.lit(after))


def composed(s, d):
    """One query for each order: inner and left joins, conditions, functions, aggregates, windows, groupings, CASEs and IN subqueries by its keys."""
    o = table(s, d, "orders")
    k = {n: _n(c, x) for n, (c, x) in _PARTS.items()}
    items = F.concat(
        F.array(F.lit("o.a0")), _each(k["f"], lambda i: _text(i, "upper(o.c", ")")), F.slice(F.array(F.lit("sum(o.x)"), F.lit("avg(o.x)")), F.lit(1), k["a"]), _each(k["w"], lambda i: F.lit("rank() OVER (ORDER BY o.a0)")),
        _each(k["e"], lambda i: F.lit("CASE WHEN o.b > 1 THEN 'x' ELSE o.y END AS k")),
    )
    joins = F.concat(_each(k["j"], lambda i: F.concat(_text(i, "INNER JOIN t"), _text(i, " ON t", ".id = o.id"))), _each(k["l"], lambda i: F.concat(_text(i, "LEFT JOIN u"), _text(i, " ON u", ".id = o.id"))))
    wheres = F.concat(_each(k["c"] + 1, lambda i: F.concat(F.when(i == 3, "o.order_date").otherwise(_text(i, "o.p")), F.lit(" = "), F.col("o_orderkey").cast("string"))), _each(k["s"], lambda i: F.lit("o.q IN (SELECT z FROM v WHERE z = 'y')")))
    groups = _each(k["g"], lambda i: _text(i, "o.g"))
    sql = F.concat(
        F.lit("SELECT "), F.array_join(items, ", "), F.lit(" FROM s.orders o "), F.array_join(joins, " "), F.lit(" WHERE "), F.array_join(wheres, " AND "),
        F.when(k["g"] > 0, F.concat(F.lit(" GROUP BY "), F.array_join(groups, ", "))).otherwise(""), F.lit(" ORDER BY o.a0 DESC LIMIT 10"),
    )
    return o.select(F.col("o_orderkey").alias("id"), sql.alias("sql"))


#: How many of each part: column and modulus.
_PARTS = {"j": ("o_orderkey", 4), "l": ("o_custkey", 3), "c": ("o_orderkey", 5), "f": ("o_custkey", 7), "a": ("o_orderkey", 3), "w": ("o_custkey", 2), "e": ("o_orderkey", 2), "g": ("o_orderkey", 3), "s": ("o_custkey", 2)}
P = "p as (select o_orderkey as id, " + ", ".join(f"cast({c} % {x} as integer) as {n}" for n, (c, x) in _PARTS.items()) + " from orders)"
# the subquery's own condition counts too
_SCORE = """least(least(3.0 * (j + l), 15) + 2 * l, 25) + least(least(5.0 * s, 15) + least(2.0 * (1 + 2 * s), 5), 20) + least(least(1.5 * (f + a + w), 10) + least((f > 0)::int + a + w, 5), 15)
    + least(least(1.5 * (j + l + 2 * (c + 1 + s) - 1 + s), 10) + least(2.0 * e, 5), 15) + least(least(2.0 * g, 6) + least(1.5 * a, 4), 10) + least(3.0 * w, 10)"""
#: Statements with what is wrong with each: (text, kinds). A number stands for the order's key.
HABITS = (
    ("SELECT * FROM users WHERE id = 1", ("SelectStar/Low",)),
    ("SELECT a FROM t WHERE lower(b) = 'k1'", ("FunctionWrappedPredicate/Medium",)),
    ("SELECT a FROM t WHERE b LIKE '%k1'", ("LeadingWildcardLike/Medium",)),
    ("SELECT id FROM t UNION SELECT id FROM u OFFSET 2000", ("OffsetWithoutLimit/Medium", "UnionInsteadOfUnionAll/Low")),
    ("SELECT id FROM t WHERE id NOT IN (SELECT id FROM u WHERE k = 1)", ("NotIn/High",)),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM v WHERE v.id = t.id AND v.k = 1)", ("CorrelatedSubquery/High",)),
    ("SELECT a, count(*) FROM t WHERE b = 1 GROUP BY a HAVING count(*) > 1", ()),
    ("NOT VALID SQL 1 ;;; @@", ()),
    ("DELETE FROM t WHERE a LIKE 'z%' AND b = 1", ()),
)
#: Normal forms of HABITS and of a list whose length differs; None: kept as it is.
FORMS = (
    "SELECT * FROM users WHERE id = $1", "SELECT a FROM t WHERE lower(b) = $1", "SELECT a FROM t WHERE b LIKE $1", "SELECT id FROM t UNION SELECT id FROM u OFFSET $1", "SELECT id FROM t WHERE id NOT IN (SELECT id FROM u WHERE k = $1)",
    "SELECT a FROM t WHERE EXISTS (SELECT $1 FROM v WHERE v.id = t.id AND v.k = $2)", "SELECT a, count(*) FROM t WHERE b = $1 GROUP BY a HAVING count(*) > $2", None, "DELETE FROM t WHERE a LIKE $1 AND b = $2",
)
LAYOUTS = (
    "SELECT *|FROM users|WHERE id = 1", "SELECT a|FROM t|WHERE lower(b) = 'k1'", "SELECT a|FROM t|WHERE b LIKE '%k1'", "SELECT id|FROM t|UNION SELECT id|FROM u|OFFSET 2000",
    "SELECT id|FROM t|WHERE id NOT IN (|  SELECT id|  FROM u|  WHERE k = 1|)", "SELECT a|FROM t|WHERE EXISTS (|  SELECT 1|  FROM v|  WHERE v.id = t.id|    AND v.k = 1|)",
    "SELECT a, count(*)|FROM t|WHERE b = 1|GROUP BY a|HAVING count(*) > 1", "NOT VALID SQL 1 ;;; @@", "DELETE|FROM t|WHERE a LIKE 'z%'|  AND b = 1",
)


def _filled(text: str) -> str:
    return text.replace("= 1", "= {0}").replace("k1", "k{0}").replace("> 1", "> {0}").replace("SQL 1", "SQL {0}").replace("SELECT 1 ", "SELECT {0} ")


def habits(s, d):
    """A statement of HABITS for each order, with its key for a literal."""
    o = table(s, d, "orders")
    text = F.element_at(F.array(*[F.lit(_filled(t)) for t, _ in HABITS]), _n("o_orderkey", len(HABITS)) + 1)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.replace(text, F.lit("{0}"), F.col("o_orderkey").cast("string")).alias("sql"))


def _quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _pick(texts) -> str:
    """The text of each order, with its key filled in."""
    return f"replace(list_value({', '.join(map(_quoted, texts))})[o_orderkey % {len(texts)} + 1], '{{0}}', cast(o_orderkey as varchar))"


_RAW = _pick([_filled(t) for t, _ in HABITS])
_FORM = f"coalesce({_pick(FORMS)}, {_RAW})"


def lists(s, d):
    """IN lists of as many elements as the order's key says, in one statement with other literals."""
    o = table(s, d, "orders")
    n = _n("o_orderkey", 9) + 2
    ids = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (i * 7).cast("string")), ", ")
    return o.select(F.concat(F.lit("select * from orders where o_orderkey = "), F.col("o_orderkey").cast("string"), F.lit(" and o_orderstatus = '"), F.col("o_orderstatus"), F.lit("' and o_custkey in ("), ids, F.lit(")")).alias("sql"))


def _columns(usage: str):
    return F.array_join(F.transform(F.filter("m.columns", lambda c: c.usage == usage), lambda c: F.concat_ws(".", c.table, c.column)), ",")


QUERIES = {
    "q2_7_1_normalize": Registered(
        lambda s, d: lists(s, d).withColumn("n", q.normalize_column("sql")).groupBy("n.normalized_query").agg(F.count("*").alias("calls"), F.sum("n.n_parameters").alias("parameters"), F.countDistinct("n.fingerprint").alias("fingerprints")),
        "select 'SELECT * FROM orders WHERE o_orderkey = $2 AND o_orderstatus = $3 AND o_custkey IN ($1)' as normalized_query, count(*) as calls, 3 * count(*) as parameters, cast(1 as bigint) as fingerprints from orders",
    ),
    "q2_7_2_normal_forms": Registered(
        lambda s, d: habits(s, d).select("id", q.normalize_column("sql").alias("n")).select("id", "n.normalized_query", "n.successful"),
        f"select o_orderkey as id, {_FORM} as normalized_query, o_orderkey % {len(FORMS)} <> {FORMS.index(None)} as successful from orders",
    ),
    "q2_7_6_fingerprint": Registered(
        lambda s, d: habits(s, d).select("id", q.normalize_column("sql").alias("n")).select("id", F.when(F.col("n.normalized_query") == FORMS[0], F.col("n.fingerprint")).alias("known"), F.length("n.fingerprint").alias("digits")),
        f"select o_orderkey as id, case when o_orderkey % {len(HABITS)} in ({', '.join(str(k) for k, f in enumerate(FORMS) if f == FORMS[0])}) then '1c00ca4a990103b5' end as known, 16::integer as digits from orders",
    ),
    "q2_7_14_fold_by_fingerprint": Registered(
        lambda s, d: habits(s, d).withColumn("n", q.normalize_column("sql")).groupBy("n.fingerprint").agg(F.count("*").alias("calls"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total")).drop("fingerprint"),
        f"select count(*) as calls, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by {_FORM}",
    ),
    "q2_10_1_complexity": Registered(
        lambda s, d: composed(s, d).select("id", m.complexity_column("sql").alias("c")).select("id", F.round("c.score", 6).alias("score"), F.col("c.class").alias("cls"), *[f"c.{x}" for x in m.COUNTS]),
        f"""with {P}, r as (select *, {_SCORE} as score from p) select id, round(cast(score as double), 6) as score, case when score < 25 then 'Simple' when score < 50 then 'Moderate' when score < 75 then 'Complex' else 'VeryComplex' end as cls,
            1 + j + l + s as tables, j + l as joins, j as inner_joins, l as outer_joins, 0 as cross_joins, s as subqueries, 0 as exists, s as in_subqueries, 1 + 2 * s as max_nesting, f + a + w as functions, a as aggregates, w as windows,
            j + l + 2 * (c + 1 + s) - 1 + s as conditions, e as cases, g as group_columns from r""",
    ),
    "q2_10_16_metadata": Registered(
        lambda s, d: composed(s, d).select("id", m.metadata_column("sql").alias("m")).select(
            "id", "m.operation", F.array_join("m.tables", ",").alias("tables"), F.array_join(F.transform("m.access", lambda x: F.substring(x, 1, 1)), "").alias("access"), _columns("Selected").alias("selected"), _columns("Filtered").alias("filtered"),
            _columns("Aggregated").alias("aggregated"), _columns("Grouped").alias("grouped"), _columns("Ordered").alias("ordered"), F.array_join(F.transform("m.functions", lambda x: F.concat(x["name"], F.lit("/"), x["category"])), ",").alias("functions"),
            "m.full_scan", "m.selectivity", F.array_join("m.index_hints", ";").alias("index_hints"),
        ),
        f"""with {P}, x as (select *, list_transform(range(1, c + 2), lambda i: case when i = 3 then 'order_date' else 'p' || i end) as cols from p)
            select id, 'Select' as operation, 's.orders' || list_aggregate(list_concat([''], list_transform(range(1, j + 1), lambda i: ',t' || i), list_transform(range(1, l + 1), lambda i: ',u' || i)), 'string_agg', '') as tables,
            'P' || repeat('I', j) || repeat('L', l) as access, 'o.a0' as selected, array_to_string(list_transform(cols, lambda n: 'o.' || n), ',') as filtered,
            array_to_string(list_concat(list_transform(range(1, f + 1), lambda i: 'o.c' || i), list_transform(range(1, a + 1), lambda i: 'o.x')), ',') as aggregated, array_to_string(list_transform(range(1, g + 1), lambda i: 'o.g' || i), ',') as grouped,
            'o.a0' as ordered, array_to_string(list_concat(list_transform(range(1, f + 1), lambda i: 'upper/String'), (['sum/Aggregate', 'avg/Aggregate'])[1:a], list_transform(range(1, w + 1), lambda i: 'rank/Window')), ',') as functions,
            false as full_scan, ([0.3, 0.1, 0.03, 0.01, 0.01])[c + 1]::double as selectivity, 'BTree o (' || array_to_string(cols, ', ') || ')' as index_hints from x""",
    ),
    "q2_10_26_classification": Registered(
        lambda s, d: composed(s, d).select("id", m.metadata_column("sql").alias("m")).select("id", "m.parallel_potential", "m.hot_data", "m.volume", "m.temporal", "m.workload", "m.resource", F.array_join("m.hints", ";").alias("hints")),
        f"""with {P}, x as (select *, j + l as n, f + a > 0 as agg from p) select id, case when agg and n > 1 then 'High' when agg <> (n > 0) then 'Medium' when not agg and n = 0 then 'Low' else 'None' end as parallel_potential,
            c >= 2 as hot_data, (['Large', 'Medium', 'Small', 'Small', 'Small'])[c + 1] as volume, case when c >= 2 then 'Recent' else 'All' end as temporal,
            case when a > 0 then case when n > 2 then 'OLAP' else 'Reporting' end when n = 0 then 'OLTP' else 'Mixed' end as workload,
            case when n > 0 and a > 0 then case when f + a + w > 5 then 'CPUIntensive' else 'Balanced' end when n > 0 then 'IOIntensive' when a > 0 then 'CPUIntensive' else 'Balanced' end as resource,
            'Indexing/High/Easy' || case when n > 3 then ';QueryRewrite/Medium/Medium' else '' end as hints from x""",
    ),
    "q2_10_33_anti_patterns": Registered(
        lambda s, d: habits(s, d).select("id", F.explode(q.anti_patterns_column("sql")).alias("a")).select("id", "a.kind", "a.severity"),
        f"""with x as (select o_orderkey as id, unnest(([{", ".join(f"[{', '.join(map(_quoted, kinds))}]::varchar[]" for _, kinds in HABITS)}])[o_orderkey % {len(HABITS)} + 1]) as k from orders)
            select id, split_part(k, '/', 1) as kind, split_part(k, '/', 2) as severity from x""",
    ),
    "q2_3_25_format_sql": Registered(
        lambda s, d: habits(s, d).select("id", q.format_column("sql").alias("sql")),
        f"select o_orderkey as id, replace({_pick([_filled(t.replace('SELECT 1|', 'SELECT 1 |')) for t in LAYOUTS]).replace(' |', '|')}, '|', chr(10)) as sql from orders",
    ),
}
