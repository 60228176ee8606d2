"""Where exports go: folders of text files (also on object stores), and Kafka's options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.paging import ORDER
from tidelog.plans.registry import SASL_OAUTH

#: What an answer of a bucket means.
OK, EXISTS = 200, 409


def target_of(rule: dict) -> str:
    """Which target of a rule with several is used."""
    for name in ("s3Bucket", "basicBucket", "kafka"):
        if rule.get(name) is not None:
            return name
    raise ValueError("the rule has no target")


def outcome(status: int) -> str:
    return {OK: "ok", EXISTS: "skipped"}.get(status, "error")


def outcome_of(status: Column) -> Column:
    """The same of a column."""
    return F.when(status == OK, "ok").when(status == EXISTS, "skipped").otherwise("error")


def write_export(lines: DataFrame, root: str) -> None:
    """Lines (``folder``, ``message``, order columns) as text files, one folder each.

    Rows are dealt by folder and order, so a folder of any size is many files and tasks. Existing
    folders of the same name are replaced, which makes a repeated export harmless.
    """
    body = F.regexp_replace("message", "\n$", "").alias("value")
    spark = lines.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt = lines.repartitionByRange("folder", *ORDER).sortWithinPartitions("folder", *ORDER)
        dealt.select("folder", body).write.partitionBy("folder").mode("overwrite").text(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def kafka_options(target: dict) -> dict[str, str]:
    """Options of Spark's Kafka sink for a target."""
    out = {"kafka.bootstrap.servers": ",".join(target["brokers"]), "topic": target["topic"]}
    tls, sasl = target.get("tls", {}), target.get("sasl", {})
    if tls.get("enable") or sasl.get("enable"):
        out["kafka.security.protocol"] = ("SASL_" if sasl.get("enable") else "") + ("SSL" if tls.get("enable") else "PLAINTEXT")
    if sasl.get("enable"):
        out["kafka.sasl.mechanism"] = sasl["mechanism"]
        if sasl["mechanism"] == SASL_OAUTH:
            out["kafka.sasl.oauthbearer.token.endpoint.url"] = sasl["tokenUrl"]
        else:
            login = "plain.Plain" if sasl["mechanism"] == "PLAIN" else "scram.Scram"
            out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.{login}LoginModule required username="{sasl["user"]}" password="{sasl["password"]}";'
    for name, option in (("compression", "kafka.compression.type"), ("retryMax", "kafka.retries")):
        if target.get(name):
            out[option] = str(target[name])
    return out


def kafka_rows(lines: DataFrame, key: str | None = None, partition: int = -1) -> DataFrame:
    """A message for each line, with its key and partition if the target names them."""
    columns = [F.lit(key).cast("binary").alias("key")] if key else []
    columns += [F.lit(partition).alias("partition")] if partition >= 0 else []
    return lines.select(F.regexp_replace("message", "\n$", "").cast("binary").alias("value"), *columns)


def s3_path(target: dict, folder: str) -> str:
    return f"s3a://{target['destination'].removeprefix('s3://').strip('/')}/{folder.strip('/')}"


def send(exported: DataFrame, rule: dict, root: str = "") -> str:
    """Writes exported lines (``folder``, ``message``, order columns) to their rule's target, and
    names its kind. Buckets are folders or object stores that Spark has a file system for."""
    kind = target_of(rule)
    target = rule[kind]
    if kind == "kafka":
        kafka_rows(exported, target.get("key"), target.get("partition", -1)).write.format("kafka").options(**kafka_options(target)).save()
    else:
        write_export(exported, s3_path(target, root) if kind == "s3Bucket" else f"{target['destination'].rstrip('/')}/{root.strip('/')}".rstrip("/"))
    return kind
