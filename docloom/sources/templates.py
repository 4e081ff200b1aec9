"""Template packs: reading, conversion, the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.fields import valid_patterns

#: Patterns of a pack that are checked on the driver.
MOST_PATTERNS = 100_000

_FIELD = "struct<field_name:string,field_type:string,description:string>"
_FULL = (
    "struct<name:string,type:string,required:boolean,patterns:array<string>,description:string,"
    "validation:struct<pattern:string,min_length:int,max_length:int,min:double,max:double,enum:array<string>>>"
)
TEMPLATE_SCHEMA = f"template_id string, document_type string, description string, priority int, match_keywords array<string>, required_fields array<{_FIELD}>, fields array<{_FULL}>"


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """A pack: a JSON array of templates, in any number of files; ``fields`` made of ``required_fields`` where there are none.

    Patterns that do not compile are dropped with a warning, as one would fail every job that meets it.
    """
    packs = required_to_fields(spark.read.schema(TEMPLATE_SCHEMA).option("multiLine", True).json(path))
    listed = packs.select(F.explode("fields").alias("f")).select(F.explode(F.concat(F.coalesce("f.patterns", F.array().cast("array<string>")), F.array("f.validation.pattern"))).alias("p"))
    written = [r["p"] for r in listed.where("p IS NOT NULL").distinct().limit(MOST_PATTERNS + 1).collect()]
    if len(written) > MOST_PATTERNS:
        raise ValueError(f"a pack holds {MOST_PATTERNS} patterns at most")
    bad = sorted(set(written) - set(valid_patterns(written)))
    if not bad:
        return packs

    def sound(f: Column) -> Column:
        check = f["validation"]
        return f.withField("patterns", F.filter(f["patterns"], lambda p: ~p.isin(*bad))).withField("validation", check.withField("pattern", F.when(~check["pattern"].isin(*bad), check["pattern"])))

    return packs.withColumn("fields", F.transform("fields", sound))


def required_to_fields(templates: DataFrame) -> DataFrame:
    """``fields`` made of ``required_fields`` where a template has none of its own."""
    made = F.transform(
        "required_fields",
        lambda x: F.struct(
            x["field_name"].alias("name"), x["field_type"].alias("type"), F.lit(True).alias("required"), F.array().cast("array<string>").alias("patterns"), x["description"].alias("description"),
            F.lit(None).cast("struct<pattern:string,min_length:int,max_length:int,min:double,max:double,enum:array<string>>").alias("validation"),
        ),
    )
    return templates.withColumn("fields", F.coalesce("fields", made))


# The template used where a caller gives none.
DEFAULT_TEMPLATE = {
    "template_id": "auto-generated",
    "fields": [
        {"name": "student_name", "type": "PERSON", "required": False, "patterns": [r"姓名[:：]\s*([^\s\n]+)"], "description": "姓名"},
        {"name": "student_id", "type": "STUDENT_ID", "required": False, "patterns": [r"学号[:：]\s*([\dA-Za-z]+)"], "description": "学号/学籍号"},
        {"name": "average_gpa", "type": "NUMBER", "required": False, "patterns": [r"绩点[:：]?\s*([\d\.]+)", r"平均绩点[:：]?\s*([\d\.]+)"], "description": "平均绩点"},
        {"name": "total_credit", "type": "NUMBER", "required": False, "patterns": [r"总学分[:：]?\s*([\d\.]+)"], "description": "总学分"},
        {"name": "stat_date", "type": "DATE", "required": False, "patterns": [r"统计时间[:：]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"], "description": "统计日期"},
    ],
}
