"""Access rules: validation, matching and the choice of the rule that decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.paths import glob_regex, has_wildcards, is_relative_pattern, match_path, specificity

#: Fixed values.
ROLES = {"viewer": 1, "editor": 2, "admin": 3}
OPERATIONS = ("read", "write", "delete", "*")
INVALID_ROLE = "Missing or invalid role claim."
DENY_DEFAULT = "No matching authority rule (deny-by-default)."
ALLOW_DEFAULT = "No matching authority rule (allow-by-default)."


def role_rank(role):
    return F.coalesce(*[F.when(F.lower(F.trim(role)) == k, v) for k, v in ROLES.items()])


def valid_rules(rules: DataFrame, operations: tuple[str, ...] = OPERATIONS, relative: bool = False) -> DataFrame:
    """Rules with known operation, effect and role, an id and a pattern; the rank comes from the role.

    ``relative`` also asks for a relative pattern. Ids stay as they are; letter case of the other fields does not
    matter. Missing priorities are 0.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    out = rules.select(
        F.trim(F.coalesce("rule_id", F.lit(""))).alias("rule_id"),
        low("operation").alias("operation"),
        F.trim(F.coalesce("path_pattern", F.lit(""))).alias("path_pattern"),
        low("effect").alias("effect"),
        low("min_role").alias("min_role"),
        role_rank(F.coalesce(F.col("min_role"), F.lit(""))).alias("min_role_rank"),
        F.coalesce(F.col("source_priority"), F.lit(0)).cast("int").alias("source_priority"),
        "policy_id",
    )
    out = out.where((F.col("rule_id") != "") & F.col("operation").isin(*operations) & F.col("effect").isin("allow", "deny") & F.col("min_role_rank").isNotNull() & (match_path(F.col("path_pattern")) != ""))
    return out.where(is_relative_pattern(F.col("path_pattern"))) if relative else out


def last_by_id(rules: DataFrame, order: str) -> DataFrame:
    """Of rules with one id the last in ``order``."""
    names = [c for c in rules.columns if c != "rule_id"]
    return rules.groupBy("rule_id").agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("rule_id", "r.*")


def matched_paths(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """p, pattern for every normalized path (p) and pattern that matches it; both are distinct.

    A literal pattern is joined by equality. A pattern with wildcards is joined on the directories before its
    first wildcard, which every path that it matches has, and only then tried.
    """
    literal = patterns.where(~has_wildcards(F.col("pattern")))
    exact = paths.join(literal, paths["p"] == literal["pattern"]).select("p", "pattern")
    fixed = F.regexp_replace(F.regexp_extract("pattern", r"^[^*?\[]*", 0), "[^/]*$", "")
    wild = patterns.where(has_wildcards(F.col("pattern"))).select("pattern", glob_regex(F.col("pattern")).alias("regex"), fixed.alias("head"))
    parts = F.split("p", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    tried = paths.select("p", F.explode(heads).alias("head")).join(wild, "head").where(F.rlike("p", "regex"))
    return exact.unionByName(tried.select("p", "pattern"))


def matches(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """request_id and rule for every rule that applies to a request, with its outcome.

    requests: request_id, operation, path, role. Distinct paths meet distinct patterns, whatever the number of
    requests and rules that share them. An allow rule applies from its rank up, a deny rule below it.
    """
    asked = requests.select("request_id", F.lower(F.trim("operation")).alias("op"), match_path(F.col("path")).alias("p"), role_rank(F.col("role")).alias("rank")).where("rank is not null")
    held = rules.withColumn("pattern", match_path(F.col("path_pattern")))
    pairs = matched_paths(asked.select("p").distinct(), held.select("pattern").distinct())
    both = asked.join(pairs, "p").join(held, "pattern").where("operation = op or operation = '*'")
    outcome = F.when((F.col("effect") == "allow") & (F.col("rank") >= F.col("min_role_rank")), "allow").when((F.col("effect") == "deny") & (F.col("rank") < F.col("min_role_rank")), "deny")
    return both.withColumn("outcome", outcome).where("outcome is not null").drop("op", "rank", "p", "pattern")


def match_counts(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """request_id, n, denies: how many rules apply to each request, where any does, and how many of them deny.

    The rows of ``matches`` are counted without being made: rules count by pattern, operation, effect and rank, and
    these numbers by path, which has as many of them as there are operations, effects and ranks.
    """
    asked = requests.select("request_id", F.lower(F.trim("operation")).alias("op"), match_path(F.col("path")).alias("p"), role_rank(F.col("role")).alias("rank")).where("rank is not null")
    kinds = ["operation", "effect", "min_role_rank"]
    held = rules.withColumn("pattern", match_path(F.col("path_pattern"))).groupBy("pattern", *kinds).agg(F.count("*").alias("n"))
    pairs = matched_paths(asked.select("p").distinct(), held.select("pattern").distinct())
    by_path = pairs.join(held, "pattern").groupBy("p", *kinds).agg(F.sum("n").alias("n")).groupBy("p").agg(F.collect_list(F.struct(*kinds, "n")).alias("held"))
    says = lambda x, effect: (x["effect"] == effect) & ((x["operation"] == F.col("op")) | (x["operation"] == "*"))
    total = lambda c: F.aggregate(F.filter("held", c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    denies = total(lambda x: says(x, "deny") & (F.col("rank") < x["min_role_rank"]))
    allows = total(lambda x: says(x, "allow") & (F.col("rank") >= x["min_role_rank"]))
    rows = asked.join(by_path, "p").select("request_id", allows.alias("allows"), denies.alias("denies"))
    out = rows.groupBy("request_id").agg(F.sum(F.col("allows") + F.col("denies")).alias("n"), F.sum("denies").alias("denies"))
    return out.where("n > 0")


def champions(rules: DataFrame) -> DataFrame:
    """Of rules with the same pattern, operation, effect and role the one that comes first: no other can decide."""
    names = ["path_pattern", "operation", "effect", "min_role", "min_role_rank"]
    best = F.min_by(F.struct("rule_id", "source_priority", "policy_id"), F.struct((-F.col("source_priority")).alias("q"), "rule_id"))
    return rules.groupBy(*names).agg(best.alias("r")).select(*names, "r.*")


def decide(requests: DataFrame, rules: DataFrame, deny_default: bool = True) -> DataFrame:
    """request_id, allowed, reason, matched_rule_id, matched_policy_id: one row per request.

    Deny comes before allow, then the more specific pattern, the higher priority, the lesser rule_id. An unknown
    role is denied. The winner is an aggregate, so a request with very many rules needs no sort of its group.
    """
    order = F.struct(F.when(F.col("outcome") == "deny", 0).otherwise(1).alias("o"), *[(-s).alias(f"s{i}") for i, s in enumerate(specificity(F.col("path_pattern")))], (-F.col("source_priority")).alias("q"), "rule_id")
    best = matches(requests, champions(rules)).groupBy("request_id").agg(F.min_by(F.struct("rule_id", "policy_id", "outcome", "min_role"), order).alias("w"))
    joined = requests.select("request_id", role_rank(F.col("role")).alias("rank")).join(best, "request_id", "left")
    told = F.when(F.col("w.outcome") == "allow", "Authorized").otherwise("Denied")
    by_rule = F.concat(told, F.lit(" by rule '"), F.col("w.rule_id"), F.lit("' (requires role>="), F.col("w.min_role"), F.lit(")."))
    reason = F.when(F.col("rank").isNull(), INVALID_ROLE).when(F.col("w").isNull(), DENY_DEFAULT if deny_default else ALLOW_DEFAULT).otherwise(by_rule)
    allowed = F.when(F.col("rank").isNull(), False).when(F.col("w").isNull(), not deny_default).otherwise(F.col("w.outcome") == "allow")
    return joined.select("request_id", allowed.alias("allowed"), reason.alias("reason"), F.col("w.rule_id").alias("matched_rule_id"), F.col("w.policy_id").alias("matched_policy_id"))


def roles_from_claims(claims: DataFrame) -> DataFrame:
    """subject, role: the highest known role named in a JSON claim set (claims: subject, payload).

    Read are ``role`` (text or list), ``realm_access.roles`` and ``resource_access.*.roles``.
    """
    v = F.try_parse_json("payload")
    role = F.try_variant_get(v, "$.role", "variant")
    listed = F.coalesce(F.try_variant_get(role, "$", "array<string>"), F.array(F.try_variant_get(role, "$", "string")))
    realm = F.coalesce(F.try_variant_get(v, "$.realm_access.roles", "array<string>"), F.array().cast("array<string>"))
    clients = F.coalesce(F.map_values(F.try_variant_get(v, "$.resource_access", "map<string,variant>")), F.array().cast("array<variant>"))
    inner = F.flatten(F.transform(clients, lambda c: F.coalesce(F.try_variant_get(c, "$.roles", "array<string>"), F.array().cast("array<string>"))))
    named = claims.select("subject", F.explode_outer(F.concat(listed, realm, inner)).alias("r"))
    known = named.select("subject", F.lower(F.trim("r")).alias("r"), role_rank(F.col("r")).alias("rank"))
    return known.groupBy("subject").agg(F.max_by("r", "rank").alias("role"))


def valid_tokens(claims: DataFrame, now: float, issuer: str, audience: str, scopes: list[str], skew: float = 60.0) -> DataFrame:
    """subject, ok: whether exp, nbf, iat, iss, aud and scope of each claim set hold at ``now`` (epoch seconds)."""
    v = F.try_parse_json("payload")
    num = lambda k: F.try_variant_get(v, f"$.{k}", "double")
    aud = F.try_variant_get(v, "$.aud", "variant")
    auds = F.coalesce(F.try_variant_get(aud, "$", "array<string>"), F.array(F.try_variant_get(aud, "$", "string")))
    scope = F.split(F.coalesce(F.try_variant_get(v, "$.scope", "string"), F.lit("")), " +")
    ok = (
        num("exp").isNotNull() & (num("exp") + skew > now)
        & (F.coalesce(num("nbf"), F.lit(now)) <= now + skew) & (F.coalesce(num("iat"), F.lit(now)) <= now + skew)
        & (F.try_variant_get(v, "$.iss", "string") == issuer) & F.coalesce(F.array_contains(auds, audience), F.lit(False))
        & (F.size(F.array_except(F.array(*map(F.lit, scopes)) if scopes else F.array().cast("array<string>"), scope)) == 0)
    )
    return claims.select("subject", F.coalesce(ok, F.lit(False)).alias("ok"))
