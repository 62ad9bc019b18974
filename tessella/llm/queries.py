"""The opN_ queries of this folder, queries of those parts that SQL can express, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import op11_bpe
from .common import read
from .decontamination import op3_decontamination
from .extraction import op6_extraction
from .language import op10_language
from .lines import op2_lines
from .near import op8_near_duplicates
from .negatives import OP12_SQL, op12_negatives
from .oracles import DECONTAMINATION_SQL, NEAR_SQL, QUALITY_SQL
from .packing import op5_packing
from .phrases import OP13_SQL, op13_phrases
from .quality import base_counts, base_failed, op4_quality
from .secrets import op7_secrets
from .urls import RULES, host_of, op1_urls, path_of, rule_for
from .warc import OP9_SQL, op9_warc


def urls_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and listed rules of op1_urls."""
    named = read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    return named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))


def _fits(rule: str) -> str:
    host, path = rule[: rule.index("/")], rule[rule.index("/") :]
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


_LONGEST = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
URLS_RULES_SQL = f"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages
)
select page_id, host, path, case {" ".join(f"when {_fits(r)} then '{r}'" for _, r in _LONGEST)} end as rule,
  case {" ".join(f"when {_fits(r)} then '{k}'" for k, r in _LONGEST)} end as listed from p
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4_quality, by its own step, which needs neither references nor distances."""
    counted = base_counts(read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


QUALITY_BASE_SQL = r"""
with t as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), w as (
  select row, i, words[i : i + 4] as five from t, unnest(range(1, greatest(len(words) - 3, 1))) r(i)
), twice as (
  select row, i from w qualify count(*) over (partition by row, five) > 1
), covered as (
  select row, count(distinct i + k) as n from twice, range(5) o(k) group by row
), l as (
  select row, unnest(string_split(text, chr(10))) as line from t
), lines as (
  select row, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by row
), c as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from t left join covered using (row) left join lines using (row)
)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c
"""


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7_secrets's fixed patterns."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
SECRETS_BASE_SQL = rf"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::bigint as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::bigint as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::bigint as n_hex
from documents
"""


QUERIES = {"op1_urls": op1_urls, "op2_lines": op2_lines, "op3_decontamination": op3_decontamination, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_extraction": op6_extraction, "op7_secrets": op7_secrets, "op8_near_duplicates": op8_near_duplicates, "op9_warc": op9_warc, "op10_language": op10_language, "op11_bpe": op11_bpe, "op12_negatives": op12_negatives, "op13_phrases": op13_phrases}
SQL = {"op9_warc": OP9_SQL, "op12_negatives": OP12_SQL, "op13_phrases": OP13_SQL}
QUERIES |= {"urls_rules": urls_rules, "quality_base": quality_base, "secrets_base": secrets_base}
SQL |= {"op3_decontamination": DECONTAMINATION_SQL, "op4_quality": QUALITY_SQL.replace("{base}", QUALITY_BASE_SQL), "op8_near_duplicates": NEAR_SQL}
SQL |= {"urls_rules": URLS_RULES_SQL, "quality_base": QUALITY_BASE_SQL, "secrets_base": SECRETS_BASE_SQL}
