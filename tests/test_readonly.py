"""SQL of users: what runs, and what is refused before anything runs."""

import os

import pytest

from graphloom.plans import readonly, store
from graphloom.plans.engine import Engine

VIEWS = frozenset(("nodes", "edges", "function", "class"))
GOOD = [
    'select label, count(*) n from nodes group by label having count(*)>1 order by n desc limit 3 offset 1',
    'with a as (select * from nodes), b as (select * from a) select a.uid, row_number() over (partition by label order by uid) from a join b using (uid) where exists (select 1 from edges e where e.src_uid=a.uid) and a.name in (select name from class)',
    "select case when name like 'a%' then 1 else cast(start_line as int) end, name||'x', base_classes[0], transform(imports, x -> upper(x)) from NODES n left join edges e on n.uid=e.src_uid",
    "with recursive r(uid, d) as (select uid, 0 from nodes where name='a' union all select e.dst_uid, d+1 from r join edges e on e.src_uid=r.uid where d<3) select distinct * from r",
    'select explode(imports) from nodes',
    'select n.uid, x from nodes n lateral view explode(imports) t as x',
    'select * from nodes where name = :name',
    'select * from nodes where name = ?',
    'values (1,2),(3,4)',
    'select 1',
    "select count(distinct label), sum(start_line) filter (where label='Class') from nodes",
    'select /*+ broadcast(e) */ * from nodes n join edges e on n.uid=e.dst_uid',
    'select (select max(line) from edges) m, n.* from nodes n',
    'select * from (select 1 a) x intersect select 2',
    'select sum(line) over w from edges window w as (partition by type)',
    "select * from nodes where start_line between 1 and 3 or name is null and not label <=> 'x'",
    'select label, type from nodes, lateral (select type from edges where src_uid=uid)',
    "select date'2020-01-01', current_date",
    'table nodes',
]
BAD = [
    'EXECUTE IMMEDIATE \'INSERT OVERWRITE DIRECTORY "/tmp/never" USING parquet SELECT 1\'',
    "SELECT REFLECT('java.lang.System','getProperty','user.home')",
    "SELECT Java_Method('java.lang.System','getProperty','user.home') from nodes",
    "select c0,c1,c2,c3,c4,c5,c6,c7,c8,c9,c10,c11,c12,c13,c14,c15,c16,c17,c18,c19,c20,c21,c22,c23,c24,c25,c26,c27,c28,c29,c30,c31,c32,c33,c34,c35,c36,c37,c38,c39, reflect('a','b') from nodes",
    "SELECT IDENTIFIER('ref'||'lect')('a','b')",
    'SELECT * FROM text.`/etc/hostname`',
    "SELECT * FROM IDENTIFIER('nodes')",
    'insert into nodes select * from nodes',
    'with a as (select 1) insert into nodes select * from a',
    "from nodes insert overwrite directory '/tmp/x' using parquet select *",
    'drop table nodes',
    'create table x as select 1',
    'set a=b',
    "add jar 'x'",
    'select * from secret',
    'select * from (with secret as (select 1) select * from secret) a join secret',
    "select raise_error('x')",
    "select * from read_files('/etc')",
    'select * from range(10)',
    'cache table nodes',
    'explain select 1',
    'show tables',
    'select input_file_name() from nodes',
    'select * from default.nodes',
    "select try_reflect('a','b')",
    '',
    'select',
    'select 1; select 2',
    'begin select 1; end',
    "select system.builtin.reflect('a','b')",
    "select * from nodes where uid in (select reflect('a','b'))",
    "select max(reflect('a','b')) over () from nodes",
    "select transform(array(1), x -> reflect('a','b'))",
    "SELECT TRANSFORM(uid) USING 'cat' FROM nodes",
    'declare x int',
    'select * from stream(nodes)',
    'select session_user()',
    'nodes |> select uid',
]


def test_queries_over_the_views_run(spark):
    for text in GOOD:
        readonly.check(spark, text, VIEWS)


def test_all_else_is_refused(spark):
    for text in BAD:
        with pytest.raises(ValueError):
            readonly.check(spark, text, VIEWS)


def test_nothing_is_written_by_a_refused_text(spark, tmp_path):
    engine, place = Engine(store.Businesses(spark, str(tmp_path)).ensure_default()), tmp_path / "written"
    for text in (f"EXECUTE IMMEDIATE 'INSERT OVERWRITE DIRECTORY \"{place}\" USING parquet SELECT 1'", f"INSERT OVERWRITE DIRECTORY '{place}' USING parquet SELECT 1"):
        with pytest.raises(ValueError):
            engine.sql(text)
    assert not os.path.exists(place)
    assert engine.sql("with x as (select uid from nodes) select count(*) as n from x").first()["n"] == 0
