"""Readers with explicit schemas; bad values become null and bad rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

PARTY = "struct<name:string,eik:string,vat_number:string,address:string>"
LAYER = f"struct<invoice_metadata:struct<number:string,date_issued:string,currency:string>,supplier:{PARTY},recipient:{PARTY},financial_summary:struct<tax_base:string,vat:string,total:string>>"
INVOICE = f"document_id string, normalized_data {LAYER}, corrected_data {LAYER}, invoice_metadata struct<number:string,date_issued:string,currency:string>, supplier {PARTY}, recipient {PARTY}, financial_summary struct<tax_base:string,vat:string,total:string>"


# A01
def read_invoices_json(spark: SparkSession, path: str) -> DataFrame:
    """The corrected layer wins over the normalised one, and that over the top level."""
    raw = spark.read.schema(INVOICE).json(path)

    def pick(c: str):
        return F.coalesce(F.col(f"corrected_data.{c}"), F.col(f"normalized_data.{c}"), F.col(c))

    return raw.select(
        "document_id", pick("invoice_metadata.number").alias("number"), S.parse_date(pick("invoice_metadata.date_issued")).alias("date_issued"), pick("invoice_metadata.currency").alias("currency"),
        pick("supplier.eik").alias("supplier_eik"), pick("supplier.name").alias("supplier_name"), pick("recipient.eik").alias("recipient_eik"),
        *(S.parse_money(pick(f"financial_summary.{c}")).alias(c) for c in ("tax_base", "vat", "total")),
    )


# A02
def read_landing_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("path").rlike(r"(?i)\.(pdf|png|jpe?g|tiff?)$")).select("path", "length", F.sha2("content", 256).alias("file_hash"))


# A03
def read_vat_registry_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Headers in either alphabet; rows without EIK are dropped."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {"eik": ("eik", "ЕИК", "EIK"), "company_name": ("company_name", "Наименование", "name"), "registered": ("vat_registration_date", "Дата на регистрация"), "deregistered": ("vat_deregistration_date", "Дата на дерегистрация")}
    col = {k: F.coalesce(*(F.col(f"`{c}`") for c in v if c in raw.columns), F.lit(None).cast("string")) for k, v in names.items()}
    out = raw.select(F.regexp_replace(col["eik"], "^BG|\\s", "").alias("eik"), col["company_name"].alias("company_name"), S.parse_date_strict(col["registered"]).alias("registered"), S.parse_date_strict(col["deregistered"]).alias("deregistered"))
    return out.where("eik IS NOT NULL AND eik <> ''").withColumn("vat_status", F.when(F.col("deregistered").isNotNull(), "DEREGISTERED").otherwise("REGISTERED"))


# A07
def read_transfer_rows(spark: SparkSession, path: str) -> DataFrame:
    """Day numbers between 30000 and 60000 are dated; others stay undated."""
    raw = spark.read.schema("kon_id long, kon int, is_kredit int, account string, amount string, date_ole double").option("header", True).csv(path)
    return raw.withColumns({"amount": S.to_money(F.col("amount")), "day": F.when((F.col("date_ole") > 30000) & (F.col("date_ole") < 60000), S.from_ole_date(F.col("date_ole")))})
