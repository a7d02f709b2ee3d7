"""Parts of the SQL statements: the graphs, attributes and series as common table expressions."""

from __future__ import annotations


def edges(quantity: int = 40, name: str = "e") -> str:
    return f"""{name}_p as (select distinct l_orderkey as o, l_partkey as p from lineitem where l_quantity >= {quantity}),
{name} as (select distinct a.p as src, b.p as dst from {name}_p a join {name}_p b on a.o = b.o and a.p <> b.p)"""


def looped(quantity: int = 45, name: str = "el") -> str:
    """The edges with self-loops at ids divisible by 97; the plain ones are e."""
    return edges(quantity) + f", {name} as (select src, dst from e union all select distinct src, src from e where src % 97 = 0)"


W = "w as (select src, dst, 1::double / count(*) over (partition by src) as w from e)"
X = "x as (select p_partkey as id, p_retailprice / 1000 as x from part where p_partkey in (select src from e))"
VEC = """v as (select p_partkey as id, p_size::double as x0, p_retailprice / 1000 as x1, coalesce(d, 0)::double as x2
  from part left join (select l_partkey, avg(l_discount) as d from lineitem group by 1) on l_partkey = p_partkey where p_partkey in (select src from e))"""


def uniform(*key: str) -> str:
    text = " || '|' || ".join(f"({k})::varchar" for k in key)
    return f"((('0x' || substr(md5({text}), 1, 12))::bigint + 0.5::double) / 281474976710656::double)"


def gaussian(*key: str) -> str:
    return f"(sqrt(-2::double * ln({uniform(chr(39) + 'u1' + chr(39), *key)})) * cos(2 * pi() * {uniform(chr(39) + 'u2' + chr(39), *key)}))"


def components(source: str = "e") -> str:
    """cc(id, comp): the least member of each node's component."""
    return f"""cc as (
  with recursive c(id, comp) using key (id) as (
    select distinct src, src from {source}
    union
    select r.id, min(c.comp) from recurring.c r join {source} g on g.src = r.id join c on c.id = g.dst where c.comp < r.comp group by r.id)
  select id, comp from c)"""


def balls(radius: int, roots: str = "select distinct src from e") -> str:
    """b(root, node, dist)."""
    steps = ["b0 as (select src as root, src as node, 0 as dist from (" + roots + ") as t(src))"]
    for d in range(1, radius + 1):
        steps.append(f"b{d} as (select root, node, min(dist) as dist from (select * from b{d - 1} union all select root, dst, {d} from b{d - 1} join e on src = node and src <> dst where dist = {d - 1}) group by root, node)")
    return ",\n".join(steps) + f",\nb as (select root, node, dist::int as dist from b{radius})"


def chain(n: int, step: str, start: str, cols: str = "id, x, eps, y") -> str:
    """y0 .. yn, each from the one before by ``step``, in which {{prev}} stands for it."""
    out = [f"y0 as materialized ({start})"]
    out += [f"y{k} as materialized ({step.replace('{prev}', f'y{k - 1}')})" for k in range(1, n + 1)]
    return ",\n".join(out)


HISTORY = """h as (select user_id as realization, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as step,
  1.3863::double + 0.05::double * sin(value / 100) as loss_d, 0.6931::double + 0.04::double * cos(value / 100) as loss_g,
  0.4::double + 0.1::double * sin(3 * (value / 100)) as beta, 1.5::double + 0.2::double * cos(2 * (value / 100)) as gamma from events)"""
RUNS = (
    HISTORY
    + """,
r as (select realization, case when realization % 11 = 3 then 'failed:nan_loss' else 'ok' end as status,
  case when realization % 11 = 3 or realization % 13 = 5 then 'nan'::double else avg(beta) end as beta_hat,
  case when realization % 11 = 3 or realization % 13 = 5 then 'nan'::double else avg(gamma) end as gamma_hat, count(*)::int as final_step
  from h group by realization)"""
)
LOGITS = "lg as (select event_id as slot, case when event_id % 2 = 0 then 'real' else 'fake' end as role, 2 * sin(value) as logit from events)"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0::double"
