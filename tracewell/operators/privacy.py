"""Personal-data columns: classification by name, reports by table, erasure and purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in match order: pattern, category, sensitivity, articles, subject. The first match counts.
CATALOG = [
    (r"\b(first_?name|last_?name|full_?name|display_?name|user_?name|username|given_?name|surname|family_?name)\b", "identity", "medium", ["Art. 4(1)"], "user"),
    (r"\b(email|email_?address|mail)\b", "contact", "high", ["Art. 4(1)"], "user"),
    (r"\b(phone|phone_?number|mobile|telephone|cell)\b", "contact", "high", ["Art. 4(1)"], "user"),
    (r"\b(address|street|city|postcode|zip|country)\b", "contact", "medium", ["Art. 4(1)"], "user"),
    (r"\b(password|passwd|password_?hash|hashed_?password|bcrypt|salt)\b", "credentials", "high", ["Art. 4(1)", "Art. 32"], "user"),
    (r"\b(access_?token|refresh_?token|auth_?token|jwt|api_?key|secret_?key|session_?token)\b", "credentials", "high", ["Art. 4(1)", "Art. 32"], "user"),
    (r"\b(session_?id|session)\b", "credentials", "medium", ["Art. 4(1)"], "user"),
    (r"\b(credit_?card|card_?number|pan|iban|bank_?account|account_?number|routing_?number)\b", "financial", "high", ["Art. 4(1)"], "customer"),
    (r"\b(salary|wage|income|payment|billing|invoice|transaction|amount|balance)\b", "financial", "medium", ["Art. 4(1)"], "customer"),
    (r"\b(health|medical|diagnosis|prescription|medication|condition|disability|allergy)\b", "health", "high", ["Art. 9"], "patient"),
    (r"\b(blood_?type|dob|date_?of_?birth|birth_?date|age|gender|sex)\b", "demographic", "high", ["Art. 9"], "user"),
    (r"\b(latitude|longitude|geo_?location|location|gps|coordinates|ip_?address|ip)\b", "location", "high", ["Art. 4(1)"], "user"),
    (r"\b(email_?verified|phone_?verified|id_?verified|kyc|verified)\b", "verification", "low", ["Art. 4(1)"], "user"),
    (r"\b(consent|opt_?in|opt_?out|gdpr_?consent|marketing_?consent)\b", "consent", "medium", ["Art. 7"], "user"),
    (r"\b(created_?at|updated_?at|last_?login|last_?seen|activity|audit|log_?in|logout)\b", "behavioural", "low", ["Art. 4(1)"], "user"),
]


def classify(columns: DataFrame) -> DataFrame:
    """columns (tbl, name) with category, sensitivity, articles, subject; non_personal where nothing matches."""
    low = F.lower(F.coalesce(F.col("name"), F.lit("")))

    def pick(values: list, other: Column) -> Column:
        return reduce(lambda c, kv: c.when(low.rlike(kv[0]), kv[1]), list(zip([x[0] for x in CATALOG], values))[1:], F.when(low.rlike(CATALOG[0][0]), values[0])).otherwise(other)

    lits = lambda k: [F.lit(x[k]) for x in CATALOG]
    articles = [F.array(*map(F.lit, x[3])) for x in CATALOG]
    return columns.select(
        "tbl",
        "name",
        pick(lits(1), F.lit("non_personal")).alias("category"),
        pick(lits(2), F.lit("none")).alias("sensitivity"),
        pick(articles, F.array().cast("array<string>")).alias("articles"),
        pick(lits(4), F.lit("unknown")).alias("subject"),
    )


def personal(columns: DataFrame) -> DataFrame:
    return classify(columns).where("category <> 'non_personal'")


def find_personal(columns: DataFrame, uses_table: DataFrame, query: str = "") -> DataFrame:
    """Personal columns with the files that use their table; ``query`` filters four columns without letter case."""
    found = personal(columns)
    if query.strip():
        q = query.strip().lower()
        found = found.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(q)) for c in ("category", "sensitivity", "tbl", "name")]))
    files = uses_table.groupBy("tbl").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return found.join(files, "tbl", "left").select("tbl", "name", "category", "sensitivity", "articles", "subject", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def summary(columns: DataFrame) -> DataFrame:
    """One row: personal columns, their counts by sensitivity, distinct articles and categories."""
    one = lambda s: F.coalesce(F.sum(F.when(F.col("sensitivity") == s, 1)), F.lit(0)).alias(s)
    return personal(columns).agg(
        F.count("*").alias("total"), one("high"), one("medium"), one("low"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("articles")))), ",").alias("articles"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )


def erasure(columns: DataFrame, uses_table: DataFrame, subject: str = "", compat: bool = False) -> DataFrame:
    """One row: columns to erase and files to touch for a kind of data subject.

    With ``compat`` the subject only restricts the files, as the original does; without, also the columns.
    """
    found = personal(columns)
    mine = F.lit(True) if not subject else F.lower("subject") == subject.lower()
    kept = found if compat else found.where(mine)
    files = kept.where(mine).select("tbl").distinct().join(uses_table, "tbl").select("file").distinct()
    return kept.agg(F.count("*").alias("total_columns")).crossJoin(files.agg(F.count("*").alias("total_files")))  # one row each
