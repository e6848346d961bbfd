"""Names resolved to addresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .reconcile import key_of, specific

_PARTS = re.compile(r"[^\W_]+")
LEAST_KEY = 4


def _first(value: str) -> str:
    parts = _PARTS.findall(value.lower())
    return parts[0] if parts else ""


class Directory:
    """Keys that lead to one address each; a key of two addresses leads nowhere."""

    def __init__(self):
        self.holders: dict[str, set[str]] = {}

    def learn(self, key: str, address: str) -> None:
        if len(key) >= LEAST_KEY:
            self.holders.setdefault(key, set()).add(address)

    def find(self, key: str) -> str | None:
        found = self.holders.get(key, ())
        return next(iter(found)) if len(key) >= LEAST_KEY and len(found) == 1 else None


def resolve_names(rows: list[dict]) -> list[dict]:
    """Name-only senders get the one address that the thread shows for their name, if there is one.

    A whole name or local part is strong evidence, the first word of either is weak and
    serves only a sender who is a single word or a key that nobody holds strongly.
    """
    whole, opening = Directory(), Directory()
    people: dict[str, dict] = {}
    reader: dict[str, bool] = {}

    def learn(address: str, name: str) -> None:
        if "@" in address:
            whole.learn(re.sub("[^a-z0-9]+", "", address.split("@")[0]), address)
            opening.learn(_first(address), address)
            if name:
                whole.learn(key_of(name), address)
                opening.learn(_first(name), address)

    for r in rows:
        for address in r.get("recipients") or []:
            learn(address, "")
        email = r["sender"]["email"] or ""
        if "@" in email:
            people.setdefault(email, r["sender"])
            reader[email] = reader.get(email, False) or bool(r.get("is_current_user"))
            learn(email, specific(r["sender"]["name"] or ""))
    out = []
    for r in rows:
        name = r["sender"]["name"] or ""
        if "@" not in (r["sender"]["email"] or "") and (key := specific(name)):
            address = whole.find(key) or opening.find(key)
            if not address and len(_PARTS.findall(name)) == 1:
                address = whole.find(_first(name)) or opening.find(_first(name))
            if address:
                sender = people.get(address) or {"name": name.strip(), "email": address}
                r = r | {"sender": sender, "is_current_user": reader.get(sender["email"], r.get("is_current_user"))}
        out.append(r)
    return out


def unique_keys(pairs: DataFrame, scope: list[str], key: str, address: str) -> DataFrame:
    """Keys of one address only: (scope, key, address)."""
    found = pairs.where(F.length(key) >= LEAST_KEY).groupBy(*scope, key).agg(F.count_distinct(address).alias("_n"), F.min(address).alias(address))
    return found.where("_n = 1").drop("_n")


def resolve(messages: DataFrame) -> DataFrame:
    """J10 as joins: name-only senders of each thread resolved; every other row as it is.

    The dictionaries are grouped from the rows themselves by thread and key, so hot threads
    are pre-aggregated before the shuffle, and joined to the name-only rows.
    """
    addressed = messages.where(F.contains("sender.email", F.lit("@")))
    first = lambda c: F.lower(F.regexp_extract(c, r"[\p{L}\p{N}]+", 0))
    local = lambda c: F.regexp_replace(F.substring_index(c, "@", 1), "[^a-z0-9]+", "")
    email, name = F.col("sender.email"), tx.specific_name(F.col("sender.name"))
    from_mail = addressed.select("thread_id", email.alias("address"), F.explode(F.array(local(email), name)).alias("strong"), F.explode(F.array(F.lit(0))).alias("_")).drop("_")
    from_list = messages.select("thread_id", F.explode("recipients").alias("address")).where(F.contains("address", F.lit("@"))).withColumn("strong", local(F.col("address")))
    strong = unique_keys(from_mail.unionByName(from_list), ["thread_id"], "strong", "address")
    weak_mail = addressed.select("thread_id", email.alias("address"), F.explode(F.array(first(email), F.when(name != "", first(F.col("sender.name"))))).alias("weak")).where("weak is not null")
    weak_list = from_list.select("thread_id", "address", first(F.col("address")).alias("weak"))
    weak = unique_keys(weak_mail.unionByName(weak_list), ["thread_id"], "weak", "address")
    people = addressed.groupBy("thread_id", email.alias("_found")).agg(F.min_by("sender", "ord").alias("_person"), F.bool_or(F.coalesce("is_current_user", F.lit(False))).alias("_reader"))
    named = ~F.contains(F.coalesce("sender.email", F.lit("")), F.lit("@"))
    single = F.size(F.regexp_extract_all("sender.name", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) == 1
    keyed = messages.withColumns(
        {"_k1": F.when(named, name), "_k2": F.when(named & (name != "") & single, first(F.col("sender.name")))}
    )
    for key in ("_k1", "_k2"):
        for kind, found in (("strong", strong), ("weak", weak)):
            keyed = keyed.join(found.select("thread_id", F.col(kind).alias(key), F.col("address").alias(f"{key}_{kind}")), ["thread_id", key], "left")
    keyed = keyed.withColumn("_found", F.coalesce("_k1_strong", "_k1_weak", "_k2_strong", "_k2_weak"))
    joined = keyed.join(people, ["thread_id", "_found"], "left")
    given = F.struct(F.col("sender.name").alias("name"), F.col("_found").alias("email"))
    out = joined.withColumns(
        {
            "is_current_user": F.coalesce("_reader", "is_current_user"),
            "sender": F.when(F.col("_found").isNull(), F.col("sender")).otherwise(F.coalesce("_person", given)),
        }
    )
    return out.select(*messages.columns)
