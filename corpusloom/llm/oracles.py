"""DuckDB SQL for those queries of the folder that SQL can express on whole tables."""

from __future__ import annotations

TOP_K = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
  from whole q join whole c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored)
select query_id, cast(rank as integer) rank, vec_id, score from ranked where rank <= 20
"""


# Bit by bit, as SQL has no CRC-32; the polynomial is a fixed value.
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
_BYTES = "list_transform(range(1, length(d) + 1), lambda i: cast(ascii(substring(d, i, 1)) as bigint))"
_CRC32 = f"xor(list_reduce({_BYTES}, lambda c, b: {_BITS}, 4294967295::bigint), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """Tables of all nodes above ``leaves`` (tree, pos, n, h), and of what stands left and right of each in its run."""
    return (
        f"{name} as (select tree, 0 as level, pos, n, h from {leaves} union all select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from {name} where n > 1 group by tree, level, pos // 8, n), "
        f"{name}_by as (select *, coalesce(string_agg(h, '') over (run rows between unbounded preceding and 1 preceding), '') l, coalesce(string_agg(h, '') over (run rows between 1 following and unbounded following), '') r "
        f"from {name} where n > 1 window run as (partition by tree, level, pos // 8 order by pos))"
    )


MERKLE = f"""
with recursive hashed as (select *, {_leaf("text")} leaf, case when {_CRC32} % 3 = 0 then {_leaf(_LOWERED)} end tampered from (select *, cast(doc_id as varchar) d from documents)),
leaves as (select doc_id, leaf, tampered, coalesce('v' || lang, 'n') tree, row_number() over w - 1 pos, count(*) over (partition by lang) n, leaf h from hashed window w as (partition by lang order by doc_id nulls first, leaf)),
{_tree("nodes", "leaves")},
subroots as (select tree name, h, row_number() over (order by tree) - 1 pos, count(*) over () n, '' tree from nodes where n = 1),
{_tree("tops", "subroots")},
levels as (select range level from range(40)),
inner_way as (select a.tree, a.pos, b.level step, b.l, b.r from leaves a cross join levels k join nodes_by b on b.tree = a.tree and b.level = k.level and b.pos = a.pos // cast(pow(8, k.level) as bigint)),
outer_way as (select s.name tree, 100 + b.level step, b.l, b.r from subroots s cross join levels k join tops_by b on b.level = k.level and b.pos = s.pos // cast(pow(8, k.level) as bigint)),
way as (select *, row_number() over (partition by tree, pos order by step) k from (select * from inner_way union all select a.tree, a.pos, o.step, o.l, o.r from leaves a join outer_way o using (tree))),
proofs as (select tree, pos, sha256(string_agg(l || r, '' order by k)) proof, max(k) most from way group by 1, 2),
folded as (select tree, pos, 0::bigint k, coalesce(tampered, leaf) h from leaves union all select f.tree, f.pos, w.k, sha256(w.l || f.h || w.r) from folded f join way w on w.tree = f.tree and w.pos = f.pos and w.k = f.k + 1)
select a.doc_id, a.leaf, s.h subroot, t.h root, coalesce(p.proof, sha256('')) proof_sha256, f.h folded_root, f.h = t.h verified
from leaves a join subroots s on s.name = a.tree join tops t on t.n = 1 left join proofs p on p.tree = a.tree and p.pos = a.pos join folded f on f.tree = a.tree and f.pos = a.pos and f.k = coalesce(p.most, 0)
"""

_SQUARED = "cast(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"


def _assigned(r: int) -> str:
    return f"a{r} as materialized (select rid, vec_id, any_value(v) v, min((d, k)) best from (select rid, p.vec_id, p.v, c.k, {_SQUARED} d from kept p cross join c{r} c) group by rid, vec_id)"


def _means(r: int) -> str:
    floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
    sums = f"select k, i, sum(x) s, count(*) n from (select best[2] k, unnest(v) x, generate_subscripts(v, 1) i from a{r}) group by k, i"
    return f"c{r + 1} as materialized (select c.k, coalesce(m.v, c.v) v from c{r} c left join (select k, list({floor} order by i) v from ({sums}) group by k) m using (k))"


CLUSTERS = f"""
with kept as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v
  from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
c0 as materialized (select k, v from (select row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), v) - 1 k, v from kept) where k < 16),
{", ".join(f"{_assigned(r)}, {_means(r)}" for r in range(3))}, {_assigned(3)}
select vec_id, cast(best[2] as integer) as cluster, best[1] distance, cast(sum(best[1]) over (partition by best[2]) as bigint) cluster_inertia, cast(sum(best[1]) over () as bigint) inertia, sha256(array_to_string(c3.v, ',')) centroid_sha256
from a3 join c3 on c3.k = best[2]
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": TOP_K, "op11_merkle_manifest": MERKLE, "op12_centroid_clustering": CLUSTERS}
