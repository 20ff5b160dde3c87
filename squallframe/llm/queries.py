"""Queries p4 to p8 and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import letters_key, plain_id
from ..session import settle, shared_root, table
from . import encoding_repair, mixing, quota_sample, stable_sample, tokens

SALT = "squallframe-1"

# Plain names of the lifecycle classes and, in order of decision, the rates that the sample's ledger gave them.
RATE_LEDGER: tuple[tuple[str | None, float], ...] = (
    ("STEADY", 0.05), ("PLATEAU", 0.05), ("GROWTH_DECAY", 0.10), ("EPISODIC", 0.10), ("RAPID_GROWTH", 0.15), ("RAPID_DECAY", 0.20), ("QUIESCENT", 0.40),
    (None, 0.05), (stable_sample.OTHER, 0.05), ("PLATEAU", 0.08),
)


def plain_class(c):
    """The plain name of a lifecycle class: by letters only; a name that is not known stays as its letters."""
    key = letters_key(c)
    out = F.upper(key)
    for name in {n for n, _ in RATE_LEDGER if n and n != stable_sample.OTHER}:
        out = F.when(key == name.replace("_", "").lower(), F.lit(name)).otherwise(out)
    return out


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled events, each once in every class in which it is selected. The rates lie in a ledger table of the shared folder."""
    rows = table(spark, sf_dir, "event_catalogue")
    ledger = stable_sample.keep_rates(spark, f"{shared_root(spark)}/squallframe/p4-ledger-{SALT}", list(RATE_LEDGER))
    got = stable_sample.stable_sample(rows, plain_id(F.col("id")), plain_class(F.col("lifecycle_class")), ledger, SALT)
    return got.select(F.col("key").alias("id"), F.col("stratum").alias("lifecycle_class"), "key_hash")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "event_catalogue")
    latest = quota_sample.latest_category(rows, plain_id(F.col("id")), letters_key(F.col("lifecycle_class")), "classified_at", "batch_no")
    asked = quota_sample.quotas(table(spark, sf_dir, "class_targets"), "request_id", letters_key(F.col("lifecycle_class")), "sample_size", "target_share", "min_rows")
    return latest, asked


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that cannot be met, from the sampler's report."""
    latest, asked = _asked(spark, sf_dir)
    _, report = quota_sample.quota_sample(latest, asked, "request_id", SALT)
    return report.where("deficit > 0").select("request_id", "lifecycle_class")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with its quota, what there is, what was drawn and what is missing."""
    latest, asked = _asked(spark, sf_dir)
    _, report = quota_sample.quota_sample(latest, asked, "request_id", SALT)
    return report.select("request_id", "lifecycle_class", "quota", "available", "sampled", "deficit")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every request."""
    latest, asked = _asked(spark, sf_dir)
    sample, _ = quota_sample.quota_sample(latest, asked, "request_id", SALT)
    return sample.select("request_id", F.col("key").alias("id"), "category")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokens.load_model(spark))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, decoded from their ids."""
    model = tokens.load_model(spark)
    return tokens.decode_documents(tokens.encode_documents(table(spark, sf_dir, "documents"), model), model)


def _mix(spark: SparkSession, sf_dir: str, loose: float = 0.0) -> tuple[DataFrame, DataFrame, mixing.Fit]:
    documents = table(spark, sf_dir, "documents")
    model = tokens.load_model(spark)
    targets = mixing.wanted(table(spark, sf_dir, "mix_targets"))
    names = sorted(r.category for r in targets.where("category is not null").select("category").distinct().collect())
    classifier = mixing.train(mixing.training_sample(documents, names), model, names)
    docs = mixing.measure(documents, model, classifier)
    fit = mixing.fit_rates(docs, targets, names, loose)
    return docs, mixing.shortages(docs, targets, fit), fit


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose source cannot give its share; documents without a source count for none."""
    _, short, _ = _mix(spark, sf_dir)
    return short.where("short").select("mix_id", "source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    docs, _, fit = _mix(spark, sf_dir)
    return mixing.draw(docs, fit, SALT).select("mix_id", "doc_id", "category", "tokens", "uses")


def _shares(spark: SparkSession, sf_dir: str, loose: float) -> DataFrame:
    docs, short, fit = _mix(spark, sf_dir, loose)
    got = mixing.share_report(settle(mixing.draw(docs, fit, SALT), "mix-drawn"), short)
    return got.select("mix_id", "source", "weight", "want", "capacity", "expected", "given", "steps", "settled", "tokens", "share", "documents", "most_uses", "short")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual shares of every mix."""
    return _shares(spark, sf_dir, 0.0)


def p7_loose_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares where documents without a source may be used once, as documents of their likeliest source."""
    return _shares(spark, sf_dir, 1.0)


def _damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encoding_repair.find_damage(documents, encoding_repair.count_pairs(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were, wholly or partly, decoded with a wrong encoding."""
    return _damage(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These documents with the likely cause and the restored text."""
    return _damage(spark, sf_dir).select("doc_id", "kind", "restored")


_ID = r"upper(regexp_replace(regexp_replace(id, '\s', '', 'g'), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i'))"
_KEY = "nullif(lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"


def _p4_sql() -> str:
    rates = stable_sample.highest_rates(list(RATE_LEDGER))
    known = {n: n.replace("_", "").lower() for n in rates if n and n != stable_sample.OTHER}
    names = " ".join(f"when '{k}' then '{n}'" for n, k in known.items())
    bound = " ".join(f"when '{n}' then '{stable_sample.threshold(rates[n])}'" for n in known)
    return f"""with k as (select {_ID} as id, {_KEY.format("lifecycle_class")} as c from event_catalogue),
n as (select distinct id, case c {names} else upper(c) end as lifecycle_class, substr(md5('{SALT}:' || id), 1, {stable_sample.DIGITS}) as key_hash
      from k where id <> '')
select id, lifecycle_class, key_hash from n
where key_hash < case when lifecycle_class is null then '{stable_sample.threshold(rates[None])}'
  else case lifecycle_class {bound} else '{stable_sample.threshold(rates[stable_sample.OTHER])}' end end"""


_LATEST_SQL = f"""r as (select {_ID} as id, {_KEY.format("lifecycle_class")} as category, classified_at, batch_no from event_catalogue),
latest as (select id, category from (
  select *, row_number() over (partition by id order by classified_at desc nulls last, batch_no desc nulls last, category desc nulls last) as k
  from r where id <> '') where k = 1 and category is not null),
seen as (select category, count(*) as available from latest group by category),
asked as (select t.*, {_KEY.format("t.lifecycle_class")} as category,
  greatest(cast(floor(sample_size * target_share + 0.5) as bigint), min_rows, 0) as quota from class_targets t)"""

QUERIES = {"p4_sample": p4_sample, "p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_loose_shares": p7_loose_shares, "p8_found": p8_found, "p8_restored": p8_restored}

SQL = {
    "p4_sample": _p4_sql(),
    "p5_found": f"with {_LATEST_SQL} select request_id, lifecycle_class from asked left join seen using (category) where quota > coalesce(available, 0)",
    "p5_report": f"""with {_LATEST_SQL} select request_id, lifecycle_class, quota, coalesce(available, 0) as available,
  least(quota, coalesce(available, 0)) as sampled, greatest(quota - coalesce(available, 0), 0) as deficit from asked left join seen using (category)""",
    "p5_sample": f"""with {_LATEST_SQL} select request_id, id, category from (
  select a.request_id, l.id, l.category, a.quota,
    row_number() over (partition by a.request_id, l.category order by substr(md5('{SALT}:' || a.request_id || ':' || l.id), 1, {stable_sample.DIGITS}), l.id) as k
  from asked a join latest l using (category)) where k <= quota""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
