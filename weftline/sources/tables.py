"""Readers for linkage inputs and adapters that view the benchmark tables as entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

NULL_TOKENS = ("", "NULL", "null", "None")


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


ENTITY = _strings("entity_id", "business_name", "business_address", "country")
NORMALIZED = _strings("entity_id", "business_name", "business_address", "country", "name_normalized", "address_normalized")
TRUTH_LIST = _strings("source1_entity_id", "matched_entity_ids")
TRUTH_PAIR = _strings("source1_entity_id", "matched_entity_id")
CANDIDATE_PAIR = _strings("source1_entity_id", "candidate_entity_id")
SCORED = StructType([*TRUTH_PAIR.fields, StructField("probability", DoubleType())])


def with_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """String columns with every null token read as null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({n: F.when(~F.col(n).isin(*tokens), F.col(n)) for n in names}) if names else df


def read_tsv(spark: SparkSession, paths: str | list[str], schema: StructType = ENTITY, quoted: bool = True, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Tab-separated files with a header, by explicit schema (never inferred); several paths are one table."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False)
    reader = reader.option("quote", '"' if quoted else "").option("mode", "PERMISSIVE")
    return with_nulls(reader.csv(paths if isinstance(paths, list) else [paths]), tokens)


def read_parquet(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Parquet file, folder or glob; only ``columns`` reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def list_to_pairs(df: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids", out: str = "matched_entity_id") -> DataFrame:
    """Comma list -> one row per id; null and empty lists give none."""
    parts = F.transform(F.split(F.coalesce(F.col(ids), F.lit("")), ","), lambda x: F.trim(x))
    return df.select(key, F.explode(parts).alias(out)).filter(F.col(out) != "")


def read_threshold(spark: SparkSession, path: str) -> float:
    """A number kept in a text file."""
    return float(spark.read.text(path).first()[0])


def documents_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: first six words as name, last eight as address, language as country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # both ends are cut off with a split limit, so long texts are not split whole
    head = F.slice(F.split(F.trim("text"), r"\s+", 7), 1, 6)
    tail = F.slice(F.split(F.reverse(F.trim("text")), r"\s+", 9), 1, 8)
    return docs.select(
        _entity_id(F.col("doc_id")).alias("entity_id"),
        F.array_join(head, " ").alias("business_name"),
        F.reverse(F.array_join(tail, " ")).alias("business_address"),
        F.col("lang").alias("country"),
    )


def parts_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: name and type as name, a made-up street address, brand as country."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    address = F.concat_ws(" ", (F.col("p_partkey") % 40).cast("string"), F.lower("p_type"), F.lit("street"), (10000 + F.col("p_size") * 97).cast("string"))
    return part.select(
        _entity_id(F.col("p_partkey")).alias("entity_id"),
        F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("business_name"),
        address.alias("business_address"),
        F.col("p_brand").alias("country"),
    )


def customers_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: trade names, units and plots in made-up names and addresses, some addresses missing."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", "lower(c_mktsegment) as m", "cast(c_nationkey as string) as n")
    name = F.expr("case when k % 5 = 0 then 'holder ' || (k % 91) || ' d/b/a ' || m || ' works' when k % 5 = 1 then m || ' works ltd' else m || ' makers' || (k % 61) || ' house' end")
    address = F.expr("case when k % 4 = 0 then '' else 'plot no h00' || (k % 10) || ' unit ' || (10 + k % 13) || ' ' || m || ' garden' end")
    return c.select(_entity_id(F.col("k")).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), F.col("n").alias("country"))


def _entity_id(key: Column) -> Column:
    return F.concat(F.lit("S"), (key % 3 + 1).cast("string"), F.lit("-"), key.cast("string"))


DUCK_ENTITIES = {
    "documents": """select 'S' || (doc_id % 3 + 1) || '-' || doc_id as entity_id,
      array_to_string(ws[1:6], ' ') as business_name,
      array_to_string(ws[greatest(len(ws) - 7, 1):len(ws)], ' ') as business_address, lang as country
      from (select *, regexp_split_to_array(trim(text), '\\s+') as ws from documents)""",
    "parts": """select 'S' || (p_partkey % 3 + 1) || '-' || p_partkey as entity_id, lower(p_name || ' ' || p_type) as business_name,
      (p_partkey % 40) || ' ' || lower(p_type) || ' street ' || (10000 + p_size * 97) as business_address, p_brand as country from part""",
    "customers": """select 'S' || (k % 3 + 1) || '-' || k as entity_id,
      case when k % 5 = 0 then 'holder ' || (k % 91) || ' d/b/a ' || m || ' works' when k % 5 = 1 then m || ' works ltd'
           else m || ' makers' || (k % 61) || ' house' end as business_name,
      case when k % 4 = 0 then '' else 'plot no h00' || (k % 10) || ' unit ' || (10 + k % 13) || ' ' || m || ' garden' end as business_address,
      n as country from (select c_custkey as k, lower(c_mktsegment) as m, c_nationkey::varchar as n from customer)""",
}


def entities(spark: SparkSession, sf_dir: str, kind: str = "documents") -> DataFrame:
    views = {"documents": documents_as_entities, "parts": parts_as_entities, "customers": customers_as_entities}
    return views[kind](spark, sf_dir)


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source 1 and the rest, by id prefix."""
    first = F.col("entity_id").startswith("S1-")
    return df.filter(first), df.filter(~first)
