"""Views over the given tables that look like the domain's tables.

Each view is SQL that means the same in Spark and DuckDB, so that a query and its
check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_txn": """
select event_id as seq, concat('txn_', lpad(cast(event_id as string), 9, '0')) as id,
 cast(ts as date) as d, hour(ts) as hour, concat('user', cast(user_id as string)) as vendor,
 value as amount, event_type as category, '' as description
 from events where value > 0""",
    "v_raw": """
select event_id as seq,
 case when event_id % 41 = 3 then 'not a date' else cast(cast(ts as date) as string) end as date,
 concat(case when user_id % 3 = 0 then '  User' else 'user' end, cast(user_id as string),
  case when user_id % 4 = 0 then ' ' else '' end) as merchant,
 case when event_id % 50 = 0 then null when event_id % 50 = 1 then 'n/a' when event_id % 50 = 2 then '-5'
  when event_id % 50 = 3 then '0' else cast(value as string) end as amount,
 case when event_id % 7 = 0 then null else event_type end as "desc"
 from events""",
    "v_charges": """
select c_custkey as k, concat('vendor', cast(c_custkey as string)) as vendor,
 date '2024-01-05' + cast(n * (22 + c_custkey % 18) as int) as d,
 cast(50 + c_custkey % 500 + n * (c_custkey % 7) as double) as amount
 from ("""
    + " union all ".join(f"select c_custkey, {n} as n from customer" for n in range(6))
    + ") as r",
    "v_inv0": """
select o.o_orderkey as k, o.o_orderkey * 10 as seq, lower(concat(n.n_name, ' ', c.c_mktsegment)) as vendor,
 case when o.o_orderkey % 97 = 0 then null else concat('INV-', lpad(cast(o.o_orderkey as string), 9, '0')) end as invoice_number,
 cast(o.o_orderdate as date) as d, l.sub as subtotal, l.tax as tax, l.sub as items_sum,
 case when o.o_orderkey % 40 = 0 then round((l.sub + l.tax) / 100) * 100
  when o.o_orderkey % 50 = 1 then round((l.sub + l.tax) * 1.1 + 0.0001, 2) else round(l.sub + l.tax, 2) end as total,
 (o.o_orderkey * 37 % 100) / 100.0 as confidence
 from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey
 left join (select l_orderkey, round(sum(l_extendedprice), 2) as sub, round(sum(l_extendedprice * l_tax) + 0.00001, 2) as tax
  from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
    "v_inv": """
select concat('inv', cast(k as string)) as invoice_id, seq, vendor, invoice_number, d, subtotal, tax,
 case when k % 60 = 2 then items_sum * 0.9 else items_sum end as items_sum, total, confidence, k from v_inv0
 union all select concat('inv', cast(k as string), 'r'), seq + 5, vendor, invoice_number, d + 3, subtotal, tax,
 items_sum, total, confidence, k from v_inv0 where k % 100 = 7""",
    "v_bank": """
select seq, concat('txn_', cast(k as string)) as id,
 case when k % 3 = 0 then vendor when k % 3 = 1 then substring(vendor, 1, length(vendor) - 3) else 'misc payee' end as vendor,
 round(total * (1 + (k % 8) * 0.015) + 0.000001, 2) as amount, d + cast(case when k % 10 = 0 then 60 else k % 9 end as int) as d,
 case when k % 4 = 0 then 'Software' else 'Travel' end as category
 from v_inv0""",
    "v_audit": """
select cast(event_id as string) as entry_id, ts as timestamp, cast(ts as date) as event_date, event_type,
 concat('user', cast(user_id as string)) as user_id, concat('inv', cast(event_id % 500 as string)) as invoice_id,
 props as details, case when event_type = 'error' and event_id % 2 = 0 then 'failure' else 'success' end as status
 from events""",
    "v_lines": """
select k, row_number() over (partition by k order by partkey, quantity, price) as line_no,
 concat(p_name, ' ', p_type) as description, quantity, unit_price, round(quantity * unit_price, 2) as line_total
 from (select l_orderkey as k, l_partkey as partkey, cast(l_quantity as int) as quantity, l_extendedprice as price,
  floor(l_extendedprice / l_quantity) + 0.25 as unit_price from lineitem where l_quantity > 0) l
 join part on p_partkey = partkey""",
    "v_doc": """
select i.k, case when i.k % 8 = 5 then concat(i.vendor, ' international procurement and logistics services') else i.vendor end as vendor,
 i.invoice_number, i.d, case when i.d between date '1990-01-03' and date '2000-01-01' then i.d end as read_d, s.subtotal, round(s.subtotal * 0.05 + 0.0001, 2) as tax,
 round(s.subtotal + round(s.subtotal * 0.05 + 0.0001, 2), 2) as total, s.n_items
 from v_inv0 i join (select k, round(sum(line_total), 2) as subtotal, count(*) as n_items from v_lines group by k) s
 on s.k = i.k""",
    "v_layout": """
select k, k % 8 as kind, replace(vendor, '_', ' ') as vendor, d, case when d between date '1990-01-03' and date '2000-01-01' then d end as read_d, s, t, round(s + t, 2) as g,
 y, round(2 * y, 2) as z, round(s - 2 * y, 2) as rest, x, round(s - x, 2) as x2, round((s - x) / 3 + 0.0001, 2) as p
 from (select *, round(s * 0.2 + 0.0001, 2) as t, floor(s * 0.3) + 0.25 as y, round(s * 0.6 + 0.0001, 2) as x
  from (select *, round(coalesce(subtotal, 1000 + k % 500) + 0.0001, 2) as s from v_inv0) a) b""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "v_inv": ("v_inv0",),
    "v_bank": ("v_inv0",),
    "v_doc": ("v_inv0", "v_lines"),
    "v_layout": ("v_inv0",),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in out:
                out.append(need)
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or given table) as a DataFrame."""
    if name in TABLES:
        return load(spark, sf_dir, name)
    for table in ("events", "orders", "lineitem", "customer", "nation", "part"):
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    for step in _order((name,)):
        spark.sql(VIEWS[step].replace('"desc"', "`desc`")).createOrReplaceTempView(step)
    return spark.table(name)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL: the views as common table expressions in front of ``sql``."""
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in _order(names))
    rest = sql.strip()
    for start in ("with recursive ", "with "):
        if rest.lower().startswith(start):
            return f"with recursive {ctes},\n{rest[len(start):]}"
    return f"with {ctes}\n{rest}"
