"""Queries of the general data problems (2, 4, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.intervals import periods_and_gaps
from cuewright.operators.nested import LEAVES, MEMBERS, nested_structure, nested_table
from cuewright.operators.replica_diff import replica_differences
from cuewright.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_structure(table(spark, sf_dir, "containers"), "scan_id", "probe_json", "scanned_at")


def _p2_table(group: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = nested_table(table(spark, sf_dir, "containers"), group, "scan_id", "probe_json", "scanned_at")
        return rows.withColumn("more", F.array_join(F.transform(F.array_sort(F.map_entries("more")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";"))

    return query


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), "path", "start_ms", "end_ms") for t in ("subtitle_events", "chapters")]
    return periods_and_gaps(parts[0].unionByName(parts[1]), ["source", "path"], "start_ms", "end_ms").select("source", "path", "kind", "start_ms", "end_ms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = replica_differences(table(spark, sf_dir, "segments"), table(spark, sf_dir, "segments_replica"), ["path"], ["title"], "scanned_at")
    tra = replica_differences(table(spark, sf_dir, "tracks"), table(spark, sf_dir, "tracks_replica"), ["path", "track_index"], ["language", "name", "codec"], "scanned_at")
    seg = seg.select(F.lit("segment").alias("entity"), "path", F.lit(-1).alias("track_index"), "diff")
    return seg.unionByName(tra.select(F.lit("track").alias("entity"), "path", "track_index", "diff"))


QUERIES = {
    "p2_found": p2_found,
    "p2_tracks": _p2_table("track"),
    "p2_chapters": _p2_table("chapter"),
    "p2_tags": _p2_table("tag"),
    "p2_simple_tags": _p2_table("simple_tag"),
    "p4_found": p4_found,
    "p7_found": p7_found,
}

SQL = {
    "p2_found": r"""
        with recursive src as (
          select scan_id, max(probe_json) as j from containers where json_valid(probe_json) group by scan_id),
        n(scan_id, kind, d, pkind, pd, obj) as (
          select scan_id, 'container', cast([] as integer[]), cast(null as varchar), cast(null as integer[]), cast(j as json) from src where json_type(j) = 'OBJECT'
          union all
          select scan_id, ckind, list_append(cd, i), kind, cd, e from (
            select scan_id, kind, cd, ckind, i, case when json_type(e) = 'VARCHAR' and json_valid(e->>'$') then cast(e->>'$' as json) else e end as e from (
              select scan_id, kind, d as cd, ckind, unnest(list) as e, unnest(range(len(list))) as i from (
                select scan_id, kind, d, ckind,
                  case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]')
                       when json_type(v) = 'OBJECT' and len(list_filter(json_keys(v), lambda x: not regexp_full_match(x, '[0-9]+'))) = 0
                         then list_transform(list_sort(list_transform(json_keys(v), lambda x: cast(x as integer))), lambda x: json_extract(v, '$."' || x || '"'))
                       when json_type(v) = 'OBJECT' then [v] else cast([] as json[]) end as list
                from (
                  select scan_id, kind, d, ckind, case when json_type(v) = 'VARCHAR' and json_valid(v->>'$') then cast(v->>'$' as json) else v end as v from (
                    select scan_id, kind, d, json_extract(obj, '$."' || k || '"') as v,
                      case kind || '.' || replace(lower(k), '_', '') when 'container.tracks' then 'track' when 'container.chapters' then 'chapter' when 'container.tags' then 'tag'
                        when 'chapter.subchapters' then 'chapter' when 'tag.simpletags' then 'simple_tag' when 'simple_tag.subtags' then 'simple_tag' end as ckind
                    from (select scan_id, kind, d, obj, unnest(json_keys(obj)) as k from n))
                  where ckind is not null)))
          ) where json_type(e) = 'OBJECT'),
        m as (select *, cast(row_number() over (partition by scan_id, kind order by d) - 1 as integer) as node from n)
        select a.scan_id, a.kind, a.node, a.pkind as parent_kind, b.node as parent_node from m a join m b on b.scan_id = a.scan_id and b.kind = a.pkind and b.d = a.pd""",
    "p4_found": """
        with spans as (
          select 'subtitle_events' as source, path, start_ms, end_ms from subtitle_events where end_ms > start_ms
          union all
          select 'chapters', path, start_ms, end_ms from chapters where end_ms > start_ms),
        a as (select *, max(end_ms) over (partition by source, path order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from spans),
        b as (select *, sum(case when before is null or start_ms > before then 1 else 0 end) over (partition by source, path order by start_ms, end_ms rows unbounded preceding) as island from a),
        p as (select source, path, min(start_ms) as start_ms, max(end_ms) as end_ms from b group by source, path, island),
        g as (select source, path, end_ms as start_ms, lead(start_ms) over (partition by source, path order by start_ms) as end_ms from p)
        select source, path, 'period' as kind, start_ms, end_ms from p
        union all
        select source, path, 'gap', start_ms, end_ms from g where end_ms - start_ms < 21600000""",
    "p7_found": """
        with s as (select path, title from segments qualify row_number() over (partition by path order by scanned_at desc) = 1),
        r as (select path, title from segments_replica qualify row_number() over (partition by path order by scanned_at desc) = 1),
        t as (select path, track_index, language, name, codec from tracks qualify row_number() over (partition by path, track_index order by scanned_at desc) = 1),
        u as (select path, track_index, language, name, codec from tracks_replica qualify row_number() over (partition by path, track_index order by scanned_at desc) = 1)
        select 'segment' as entity, path, cast(-1 as integer) as track_index, 'missing_in_replica' as diff from s anti join r using (path)
        union all select 'segment', path, -1, 'missing_in_primary' from r anti join s using (path)
        union all select 'segment', path, -1, 'title' from s join r using (path) where s.title is distinct from r.title
        union all select 'track', path, track_index, 'missing_in_replica' from t anti join u using (path, track_index)
        union all select 'track', path, track_index, 'missing_in_primary' from u anti join t using (path, track_index)
        union all select 'track', path, track_index, 'language' from t join u using (path, track_index) where t.language is distinct from u.language
        union all select 'track', path, track_index, 'name' from t join u using (path, track_index) where t.name is distinct from u.name
        union all select 'track', path, track_index, 'codec' from t join u using (path, track_index) where t.codec is distinct from u.codec""",
}


_NODES = SQL["p2_found"][: SQL["p2_found"].rindex("select a.scan_id")]


def _p2_sql(group: str) -> str:
    """The leaves of a group's objects by their keys, over the same walk; of two spellings the last with a value."""

    def at(obj: str, leaf: str) -> str:
        return f"""json_extract({obj}, '$."' || list_filter(json_keys({obj}), lambda x: replace(lower(x), '_', '') = '{leaf}' and json_type(json_extract({obj}, '$."' || x || '"')) <> 'NULL')[-1] || '"')"""

    def value(leaf: str) -> str:
        outer, _, inner = leaf.partition(".")
        return at(at("a.obj", outer), inner) if inner else at("a.obj", outer)

    text = lambda leaf: f"case when json_type({value(leaf)}) = 'VARCHAR' then {value(leaf)}->>'$' else cast({value(leaf)} as varchar) end as {leaf.replace('.', '_')}"
    known = ", ".join(f"'{x.split('.')[0]}'" for x in [*LEAVES[group], *MEMBERS[group]])
    keys = f"list_filter(json_keys(a.obj), lambda x: replace(lower(x), '_', '') not in ({known}) and json_type(json_extract(a.obj, '$.\"' || x || '\"')) <> 'NULL')"
    more = f"coalesce(list_aggregate(list_sort(list_transform({keys}, lambda x: replace(lower(x), '_', '') || '=' || json_extract_string(a.obj, '$.\"' || x || '\"'))), 'string_agg', ';'), '')"
    return _NODES + f"select a.scan_id, a.node, a.pkind as parent_kind, b.node as parent_node, {', '.join(text(x) for x in LEAVES[group])}, {more} as more from m a join m b on b.scan_id = a.scan_id and b.kind = a.pkind and b.d = a.pd where a.kind = '{group}'"


SQL |= {f"p2_{g}s": _p2_sql(g) for g in LEAVES}
