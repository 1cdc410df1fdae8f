"""Queries over the test tables for the core's operators on raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from baglight.operators import compaction, nested
from baglight.sources.tables import table


def p5_store(spark: SparkSession, d: str) -> compaction.Store:
    spec = table(spark, d, "store_specs").filter("store = 'cache'").head()
    files = table(spark, d, "cache_files", "file_id", "file_path", "payload", "written_at")
    return compaction.compact(files, spec.target_bytes, spec.max_bytes)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_store(spark, d).rows.select("uid", "file_id")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return compaction.file_sizes(p5_store(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_objects(table(spark, d, "annotation_files", "file_id", "payload", "read_at"))


def _p4_table(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.nested_table(table(spark, d, "annotation_files", "file_id", "payload", "read_at"), name)

    return query


QUERIES = {"p4_found": p4_found, "p4_images": _p4_table("image"), "p4_objects": _p4_table("object"), "p4_rings": _p4_table("ring"), "p4_points": _p4_table("point"), "p5_found": p5_found, "p5_files": p5_files}

_BARE = "trim({c}, chr(65279) || chr(32) || chr(9) || chr(10) || chr(13))"

ORACLES = {
    "p4_found": rf"""
with recursive cur as (select file_id, payload from annotation_files qualify row_number() over (partition by file_id order by read_at desc) = 1),
open(file_id, p) as (
  select file_id, {_BARE.format(c='payload')} from cur
  union select file_id, {_BARE.format(c="json_extract_string(p, '$')")} from open where json_valid(p) and json_type(p) = 'VARCHAR'),
tree as (
  select o.file_id, t.id, t.type, t.value, t.atom, t.fullkey as k, t.path, t.key,
    regexp_extract(t.fullkey, '^\$\.export\.batches(\[\d+\])?\.images(\[\d+\])?') as tree_image
  from (select file_id, p from open where json_valid(p) and json_type(p) = 'OBJECT') o, json_tree(o.p) t),
kind as (
  select file_id, case when bool_or(k = '$.export') then 'tree' when bool_or(k in ('$.annotations', '$.images')) then 'linked' else 'shapes' end as kind from tree group by file_id),
named as (
  select file_id, path, regexp_extract(json_extract_string(value, '$'), '[^/\\]*$') as image_name, k from tree
  where key in ('file_name', 'imagePath') and type = 'VARCHAR'),
things as (
  select t.file_id, kind, t.id, t.value, k, tree_image from tree t join kind using (file_id) where type = 'OBJECT' and (
    kind = 'shapes' and regexp_matches(k, '^\$\.shapes(\[\d+\])?$') or kind = 'linked' and regexp_matches(k, '^\$\.annotations(\[\d+\])?$')
    or kind = 'tree' and regexp_matches(k, '^\$\.export\.batches(\[\d+\])?\.images(\[\d+\])?\.objects(\[\d+\])?(\.parts(\[\d+\])?)*$'))),
numbered as (
  select *, case when kind = 'tree' then row_number() over (partition by file_id order by id)
    else 1 + coalesce(try_cast(nullif(regexp_extract(k, '\[(\d+)\]$', 1), '') as bigint), 0) end as object_no from things),
images as (
  select t.file_id, json_extract_string(t.value, '$.id') as id, any_value(n.image_name order by t.id) as image_name
  from tree t join kind using (file_id) join named n on n.file_id = t.file_id and n.path = t.k
  where kind = 'linked' and t.type = 'OBJECT' and regexp_matches(t.k, '^\$\.images(\[\d+\])?$') group by all)
select o.file_id, n.image_name, o.object_no from numbered o join named n on n.file_id = o.file_id and n.k = '$.imagePath' where kind = 'shapes'
union all select o.file_id, n.image_name, o.object_no from numbered o join named n on n.file_id = o.file_id and n.k = tree_image || '.file_name' where kind = 'tree'
union all select o.file_id, i.image_name, o.object_no from numbered o join images i on i.file_id = o.file_id and i.id = json_extract_string(o.value, '$.image_id') where kind = 'linked'
""",
    "p5_found": r"""
with lines as (
  select file_id, written_at, unnest(string_split_regex(payload, '\r\n|\n|\r')) as line
  from (select distinct file_id, file_path, payload, written_at from cache_files)
  where not (regexp_matches(file_path, '(^|/)[_.]') or file_path like '%.tmp')),
records as (
  select file_id, written_at, json_extract_string(line, '$.uid') as uid from lines
  where trim(line) <> '' and json_valid(line))
select uid, arg_max(file_id, (written_at, file_id)) as file_id from records where uid is not null group by uid
""",
}
