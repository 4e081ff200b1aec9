"""Chinese forms rendered from the relational tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "translate(substr(lpad(cast(c_custkey as varchar(20)), 6, '0'), 4, 3), '0123456789', '赵钱孙李周吴郑王冯陈')"
_GENDER = "case when c_custkey % 2 = 0 then '男' else '女' end"

_LEAVE = f"""
select o_orderkey as doc_id,
       concat('请、销假单', {{nl}}, '姓名：', {_NAME}, ' 学号：', cast(200000000 + o_orderkey as varchar(20)),
              ' 班级：软升', lpad(cast(c_nationkey as varchar(20)), 3, '0'), {{nl}}, '请假原因：论文调研', {{nl}},
              '开始日期：', {{day}}, {{nl}}, '本人手机号：_1', cast(3 + o_orderkey % 7 as varchar(20)),
              lpad(cast(o_custkey as varchar(20)), 9, '0'), {{nl}}, '金额：', cast(cast(floor(o_totalprice) as bigint) as varchar(20)), '元') as text
from orders join customer on o_custkey = c_custkey
"""
_ROSTER = f"""
select cast(c_nationkey + 25 * block as bigint) as doc_id, concat('班级成员表', {{nl}}, '序号 班级 姓名 性别', {{nl}}, {{agg}}) as text
from (select c_nationkey, cast(floor(c_custkey / 1250) as bigint) as block, c_custkey, concat(cast(c_custkey % 1000 as varchar(20)), ' 软升', lpad(cast(c_nationkey as varchar(20)), 3, '0'), ' ', {_NAME}, ' ', {_GENDER}) as ln from customer) r
group by c_nationkey, block
"""
_TRANSCRIPT = """
select l_orderkey as doc_id, concat('成绩单', {nl}, {agg}) as text
from (select l_orderkey, l_linenumber,
             concat('2024-2025-', cast(1 + l_linenumber % 2 as varchar(20)), ' ', cast(100000 + l_partkey as varchar(20)), ' ', lpad(cast(l_linenumber as varchar(20)), 2, '0'), ' ',
                    case l_returnflag when 'A' then '高等数学' when 'N' then '大学英语' else '数据结构' end, ' 必修 ',
                    cast(cast(floor(l_quantity) as bigint) as varchar(20)), ' ', cast(60 + l_suppkey % 40 as varchar(20)), ' ', cast(1 + l_linenumber % 4 as varchar(20)), '.0') as ln
      from lineitem) r
group by l_orderkey
"""
_CARD = """
select c_custkey as doc_id,
       concat('姓名 周宇清 性别 ', case when c_custkey % 2 = 0 then '男' else '女' end, ' 软件工程丨普通全日制 学号 ', cast(242040000 + c_custkey as varchar(20)),
              ' 民族 汉族 学制 ', cast(2 + c_custkey % 3 as varchar(20)), '年 系所 计算机学院 班级 软升', lpad(cast(c_nationkey as varchar(20)), 3, '2'),
              ' 学历类别 普通高等教育 入学日期 2024年9月', cast(1 + c_custkey % 28 as varchar(20)), '日 学校名称 马鞍山大学 验证码 ', lpad(cast(c_custkey as varchar(20)), 8, '9')) as text
from customer
"""
_LOAN = """
select o_orderkey as doc_id,
       concat('生源地助学贷款回执', {nl}, '学生姓名 王小明', {nl}, '贷款合同编号 ', lpad(cast(o_orderkey as varchar(20)), 12, '7'), {nl},
              '用款期限 ', cast(6 + o_custkey % 90 as varchar(20)), '（月）', {nl}, '本次用款金额 ', cast(cast(floor(o_totalprice) as bigint) as varchar(20)), '.5（元）', {nl},
              '开户行 安徽农村商业银行官庄支行', {nl}, '回执验证码为：', lpad(cast(o_custkey as varchar(20)), 6, '1'), {nl}, {day}) as text
from orders
"""
_TABLES = """
select l_orderkey as doc_id, 0 as table_no, concat('<table>', {agg}, '</table>') as html
from (select l_orderkey, l_linenumber,
             concat('<tr><td>', cast(l_linenumber as varchar(20)), '</td><td>', cast(l_partkey as varchar(20)), '</td><td>', cast(cast(floor(l_quantity) as bigint) as varchar(20)), '</td></tr>') as ln
      from lineitem) r
group by l_orderkey
"""
_PARTS = {
    "leave_forms": (_LEAVE, ("orders", "customer"), "", ""),
    "rosters": (_ROSTER, ("customer",), "c_custkey", "\n"),
    "cards": (_CARD, ("customer",), "c_custkey", ""),
    "loans": (_LOAN, ("orders",), "o_orderkey", ""),
    "transcripts": (_TRANSCRIPT, ("lineitem",), "l_linenumber", "\n"),
    "html_tables": (_TABLES, ("lineitem",), "l_linenumber", ""),
}


def render(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rendered fixture; its source tables are read from ``sf_dir``."""
    sql, tables, key, sep = _PARTS[name]
    # Sorted as an array: listagg sets up its order anew for every group, which costs more than all else.
    listed = f"sort_array(collect_list(struct({key} as k, ln as ln)) filter (where ln is not null))"
    agg = f"case when count(ln) > 0 then array_join(transform({listed}, x -> x.ln), '{sep.encode('unicode_escape').decode()}') end"
    text = sql.format(nl="'\\n'", day="date_format(o_orderdate, 'yyyy-MM-dd')", agg=agg)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name in ("cards", "loans"):
        # Small rows that much work hangs on: a file of one row group would leave all of it to one task. By number, as
        # what is dealt by key alone is put together again to partitions of 1 MB.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        frames = {t: df.repartition(tasks, key) for t, df in frames.items()}
    for t, df in frames.items():
        df.createOrReplaceTempView(f"fixture_{t}")
        text = text.replace(f"from {t}", f"from fixture_{t}").replace(f"join {t}", f"join fixture_{t}")
    return spark.sql(text)


def oracle(name: str) -> str:
    """The same fixture as DuckDB SQL."""
    sql, _, key, sep = _PARTS[name]
    agg = f"string_agg(ln, {'chr(10)' if sep else repr(sep)} order by {key}, ln)"
    return sql.format(nl="chr(10)", day="strftime(cast(o_orderdate as date), '%Y-%m-%d')", agg=agg)
