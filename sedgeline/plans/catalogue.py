"""Queries over the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline import scratch, vocab
from sedgeline.functions import answers, checklist, identity, prompts, text
from sedgeline.operators import census, firewall, mix, neighbors, ordinal, registry, rules, scoring, selection
from sedgeline.plans.base import FROZEN, ORACLE_SQL, QUERIES, SPACE, WORD, nfkc, norm0, norm1, query, sha, split_name, template
from sedgeline.session import table
from sedgeline.sizing import small
from sedgeline.sources import sinks
from sedgeline.streaming import runlog


# Firewall and hashes


@query(f"""
SELECT d.source, count(*) AS candidates, count(*) FILTER (WHERE e.h IS NOT NULL) AS blocked, count(*) FILTER (WHERE e.h IS NULL) AS allowed
FROM documents d LEFT JOIN (SELECT DISTINCT sha256({norm0('text')}) AS h FROM eval_items) e ON e.h = sha256({norm0('d.text')}) GROUP BY d.source""")
def firewall_by_source(spark, d):
    flagged = firewall.flagged_v0(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked")).alias("allowed"))


@query(f"""
SELECT lang, count(*) AS kept FROM documents d WHERE NOT EXISTS (SELECT 1 FROM eval_items e WHERE sha256({norm0('e.text')}) = sha256({norm0('d.text')})) GROUP BY lang""")
def firewall_anti_join(spark, d):
    return firewall.survivors_v0(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""
WITH h AS (SELECT doc_id, sha256({norm0('text')}) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)""")
def repeated_documents(spark, d):
    h = table(spark, d, "documents").select("doc_id", identity.hash_v0(F.col("text")).alias("h"))
    many = h.dropna().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return h.join(many, "h", "left_semi").select("doc_id")


def _checked(spark, d, splits) -> DataFrame:
    """The inventory's records (record_no, split, decision) whose split meets a condition, against the frozen evaluation: the
    hashes of its validation, test and external_eval splits, and of the items. Every prompt is normalized once."""
    prompt = F.col("canonical_prompt")
    inv = table(spark, d, "inventory").select("record_no", text.split_name(F.col("source_split")).alias("split"), prompt.alias("prompt"), (F.length(prompt) > 0).alias("filled"))
    hashed = firewall.hashed(inv).drop("prompt")
    items = firewall.freeze(table(spark, d, "eval_items").select(F.col("text").alias("prompt")))
    held = hashed.where("split <> 'train' and filled")
    keys = ["exact_prompt_hash", "template_fingerprint"]
    return firewall.check(hashed.where(splits), *firewall.hash_sets(held.select(*keys).unionByName(items.select(*keys))))


@query(f"""
WITH {FROZEN}
SELECT NOT (exact_match OR template_match) AS allowed, exact_match, template_match, count(*) AS row_count
FROM firewall_ JOIN inventory USING (record_no) WHERE {split_name('source_split')} = 'train' GROUP BY ALL""")
def firewall_decisions(spark, d):
    """Training prompts of the inventory, in any spelling of the split, against hashes frozen from its evaluation splits and the items."""
    checked = _checked(spark, d, F.col("split") == "train")
    return checked.groupBy("decision.allowed", "decision.exact_match", "decision.template_match").agg(F.count(F.lit(1)).alias("row_count"))


@query(f"""
WITH {FROZEN} SELECT exact AS exact_prompt_hash, row_number() OVER (ORDER BY exact) - 1 AS ordinal FROM (SELECT DISTINCT exact FROM frozen_)""")
def frozen_hashes(spark, d):
    """The frozen hashes, each once, in their order."""
    inv = table(spark, d, "inventory").where(text.split_name(F.col("source_split")) != "train").select(F.col("canonical_prompt").alias("prompt"))
    entries = firewall.freeze(inv.unionByName(table(spark, d, "eval_items").select(F.col("text").alias("prompt"))))
    return ordinal.with_ordinal(firewall.hash_sets(entries)[0], "exact_prompt_hash")


@query(f"SELECT doc_id, sha256({norm0('text')}) AS h FROM documents")
def norm_v0_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", identity.hash_v0(F.col("text")).alias("h"))


@query(f"SELECT record_no, {sha('canonical-content', norm1('canonical_prompt'))} AS h FROM inventory")
def norm_v1_hash(spark, d):
    return table(spark, d, "inventory").select("record_no", identity.content_hash(F.col("canonical_prompt")).alias("h"))


@query(f"SELECT {sha('template', template('canonical_prompt'))} AS h, count(*) AS n FROM inventory GROUP BY 1")
def template_fingerprints(spark, d):
    h = table(spark, d, "inventory").select(identity.template_fingerprint(F.col("canonical_prompt")).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_id, {sha('message', chr(39) + 'user' + chr(39), norm1('text'))} AS h FROM eval_items")
def message_hashes(spark, d):
    return table(spark, d, "eval_items").select("item_id", identity.message_hash(F.col("text"), F.lit("user")).alias("h"))


@query(f"SELECT original_id, dataset || '@' || revision || '/' || source_split || '/' || original_id AS source_key, {sha('source-family', 'source_key')} AS family_id FROM source_records".replace("'norm-v1' || chr(31) || source_key", "'norm-v1' || chr(31) || source_records.source_key"))
def source_families(spark, d):
    s = table(spark, d, "source_records")
    made = identity.source_key(F.col("dataset"), F.col("revision"), F.col("source_split"), F.col("original_id"))
    return s.select("original_id", made.alias("source_key"), identity.source_family(F.col("source_key")).alias("family_id"))


@query(f"SELECT line_no, {sha('training-row', 'family_id', 'selected_behavior', 'constraint_signature', 'renderer_version')} AS made FROM training_rows")
def row_identifiers(spark, d):
    made = identity.row_id(*(F.col(c) for c in ("family_id", "selected_behavior", "constraint_signature", "renderer_version")))
    return table(spark, d, "training_rows").select("line_no", made.alias("made"))


@query("""
SELECT item_id, 'sha256:' || sha256('constraints' || chr(31) || 'norm-v1' || chr(31) || '[{"id":"behavior","parameters":{"value":"' || behavior || '"}},{"id":"subject","parameters":{"value":"' || subject || '"}}]') AS signature FROM eval_items""")
def constraint_signatures(spark, d):
    item = lambda k: F.struct(F.lit(k).alias("id"), F.create_map(F.lit("value"), F.col(k)).alias("parameters"))
    return table(spark, d, "eval_items").select("item_id", identity.constraint_signature_flat(F.array(item("subject"), item("behavior"))).alias("signature"))


# Text functions


@query(r"""
SELECT source, count(*) FILTER (WHERE regexp_matches(text, '####')) AS final_marks, count(*) FILTER (WHERE regexp_matches(text, '<<[^>]*>>')) AS spans,
       count(*) FILTER (WHERE regexp_matches(text, '(?i)</?think>')) AS thinks,
       count(*) FILTER (WHERE regexp_matches(text, '(?i)(<think>|</think>|####|<<[^>]*>>|<\|(?:assistant|user|system)\|>)')) AS artifacts FROM documents GROUP BY source""")
def artifact_scan(spark, d):
    has = lambda c: F.count_if(c)
    t, artifact = F.col("text"), F.lower(text.find_artifact(F.col("text")))
    marks = table(spark, d, "documents").select("source", t.contains("####").alias("m"), text.has_markup(F.replace(t, F.lit("####"), F.lit(""))).alias("s"), artifact.alias("a"), text.find_artifact(F.regexp_replace(t, text.MARKUP, "")).alias("rest"))
    return marks.groupBy("source").agg(has("m").alias("final_marks"), has("s").alias("spans"), F.count_if(F.lower("rest").isin("<think>", "</think>")).alias("thinks"), F.count("a").alias("artifacts"))


@query(r"SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)(<think>|</think>|####|<<[^>]*>>|<\|(?:assistant|user|system)\|>)', 1)), '') AS artifact FROM documents")
def first_artifact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(text.find_artifact(F.col("text"))).alias("artifact"))


@query(rf"""
WITH t AS (SELECT record_no, replace(lower(coalesce(canonical_prompt, '')), ',', '') AS t FROM inventory)
SELECT record_no, coalesce(regexp_extract_all(t, '-?\p{{Nd}}+(?:\.\p{{Nd}}+)?')[-1], regexp_extract_all(t, '[^{SPACE[1:]}+')[-1], '') AS answer FROM t""")
def answer_extract(spark, d):
    return table(spark, d, "inventory").select("record_no", answers.normalize_answer(F.col("canonical_prompt")).alias("answer"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '<<([^>=]+)=([^>]+)>>')) AS spans, nullif(trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 1)), '') AS expr, nullif(trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 2)), '') AS val FROM documents")
def calculation_spans(spark, d):
    s = answers.spans(F.col("text"))
    first = F.try_element_at(s, F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("spans"), first["expr"].alias("expr"), first["val"].alias("val"))


@query(r"""
SELECT doc_id, nullif(regexp_extract(text, '####\s*(-?\p{Nd}+(?:\.\p{Nd}+)?)', 1), '') AS gold,
 CASE WHEN gold LIKE '%.%' THEN CAST(CASE WHEN CAST(gold AS DOUBLE) <> 0 THEN CAST(gold AS DOUBLE) + 1 ELSE CAST(gold AS DOUBLE) - 1 END AS VARCHAR)
      ELSE CAST(CASE WHEN CAST(gold AS HUGEINT) <> 0 THEN CAST(gold AS HUGEINT) + 1 ELSE -1 END AS VARCHAR) END AS wrong FROM documents WHERE text LIKE '%####%'""")
def wrong_answers(spark, d):
    """Of documents with the mark of a final answer."""
    gold = answers.final_answer(F.col("text"))
    return table(spark, d, "documents").where(F.col("text").contains("####")).select("doc_id", gold.alias("gold"), answers.wrong_answer(gold).alias("wrong"))


_V = r"-?\p{Nd}+(?:\.\p{Nd}+)?"
_S = SPACE


@query(rf"""
WITH a AS (SELECT doc_id, text, string_split(regexp_replace(text, '={_S}*(\$?)<<[^>=]+={_S}*({_V}){_S}*>>{_S}*({_V})', chr(1) || '\1\2' || chr(2) || '\2' || chr(2) || '\3' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE regexp_matches(text, '####|<<[^>]*>>')),
b AS (SELECT doc_id, text, array_to_string(list_transform(parts, lambda x: CASE WHEN NOT contains(x, chr(2)) THEN x
   WHEN string_split(x, chr(2))[2] = string_split(x, chr(2))[3] THEN '= ' || string_split(x, chr(2))[1] ELSE '= ' || string_split(x, chr(2))[1] || ' (' || string_split(x, chr(2))[3] || ')' END), '') AS t FROM a),
c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(t, '={_S}*(\$?)<<[^>=]+={_S}*([^>]*?){_S}*>>{_S}*({_V})', '= \1\2 (\3)', 'g'), '={_S}*(\$?)<<[^>=]+={_S}*([^>]*?){_S}*>>', '= \1\2', 'g'), '<<{_S}*([^>=]+?){_S}*={_S}*([^>]*?){_S}*>>', '\1 = \2', 'g') AS t FROM b),
e AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(t, '####{_S}*({_V})', '', 'g'), '=([^{_S[1:]})', '= \1', 'g'), '={_S}+', '= ', 'g') AS t FROM c),
f AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: x <> '') AS l FROM e)
SELECT doc_id, coalesce(array_to_string(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^\p{{Nd}}+[.)]{_S}') THEN x ELSE i || '. ' || x END), chr(10)), '')
  || CASE WHEN regexp_matches(text, '####{_S}*({_V})') THEN chr(10) || chr(10) || 'Final answer: ' || regexp_extract(text, '####{_S}*({_V})', 1) ELSE '' END AS solution FROM f""")
def clean_solutions(spark, d):
    return table(spark, d, "documents").where(text.has_markup(F.col("text"))).select("doc_id", answers.clean_solution(F.col("text")).alias("solution"))


@query(r"""
SELECT record_no, CASE WHEN len(n) >= 2 THEN 'Combine ' || n[1] || ' and ' || n[2] || ' first. What does the result stand for?'
  ELSE 'Name the first operation before you compute. What is still unknown after it?' END AS hint
FROM (SELECT record_no, regexp_extract_all(coalesce(canonical_prompt, ''), '\p{Nd}+(?:\.\p{Nd}+)?') AS n FROM inventory)""")
def hints(spark, d):
    return table(spark, d, "inventory").select("record_no", answers.hint(F.col("canonical_prompt"), F.lit(None).cast("string")).alias("hint"))


@query(r"""
WITH t AS (SELECT doc_id, nullif(trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 1)), '') AS expr, trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 2)) AS val,
  len(regexp_extract_all(coalesce(text, ''), '<<([^>=]+)=([^>]+)>>')) AS spans, regexp_extract_all(coalesce(text, ''), '\p{Nd}+(?:\.\p{Nd}+)?') AS n FROM documents)
SELECT doc_id, CASE WHEN spans > 0 THEN 'Begin with ' || coalesce(expr, '') || ', which should come to about ' || val || '. What does that value stand for?'
  WHEN len(n) >= 2 THEN 'Combine ' || n[1] || ' and ' || n[2] || ' first. What does the result stand for?'
  ELSE 'Name the first operation before you compute. What is still unknown after it?' END AS hint FROM t""")
def solution_hints(spark, d):
    """Hints of the documents as worked solutions of themselves: from spans, numbers, or general."""
    return table(spark, d, "documents").select("doc_id", answers.hint(F.col("text"), F.col("text")).alias("hint"))


@query("SELECT doc_id, length(text) - length(replace(text, '?', '')) AS questions, left(coalesce(text, ''), 240) AS preview FROM documents")
def question_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.question_count(F.col("text")).alias("questions"), text.preview(F.col("text")).alias("preview"))


@query(r"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\pL')) AS letters, len(regexp_extract_all(text, '[ሀ-ፚᎀ-ᎏⶀ-ⷞꬁ-ꬮ]')) AS own FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(own / letters, 6) AS share FROM n WHERE letters > 0 AND own / letters > 0.2""")
def script_filter(spark, d):
    """The documents of which more than a fifth of the letters are Ethiopic."""
    share = table(spark, d, "documents").select("doc_id", text.script_share(F.col("text")).alias("share"))
    return share.where("share > 0.2").withColumn("share", F.round("share", 6))


@query(r"""
SELECT subject, round(sum(length(text)) / sum(len(regexp_extract_all(text, '[^\s\p{Z}\x0B\x1C-\x1F\x85]+'))), 6) AS fertility FROM eval_items GROUP BY subject""")
def fertility(spark, d):
    """Characters a word by subject, as tokens would be."""
    items = table(spark, d, "eval_items").select("subject", F.length("text").alias("tokens"), text.word_count(F.col("text")).alias("words"))
    return selection.fertility(items, "tokens", "words", "subject").withColumn("fertility", F.round("fertility", 6))


@query(rf"""
WITH t AS (SELECT record_no, regexp_replace(regexp_replace(lower({nfkc('canonical_prompt')}), '([0-9]),([0-9]{{3}})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{{3}})($|[^0-9])', '\1\2\3', 'g') AS t FROM inventory),
f AS (SELECT record_no, t, list_zip(regexp_extract_all(t, '(?:^|[^{WORD}.])(-?[0-9]+)\s*/\s*([0-9]+)(?:$|[^{WORD}.]|\.(?:$|[^0-9]))', 1), regexp_extract_all(t, '(?:^|[^{WORD}.])(-?[0-9]+)\s*/\s*([0-9]+)(?:$|[^{WORD}.]|\.(?:$|[^0-9]))', 2)) AS fractions FROM t)
SELECT record_no FROM f WHERE regexp_matches(t, '(^|[^{WORD}./-]|[{WORD}./]-)0*12(\.0+)?($|[^{WORD}/.]|\.($|[^0-9]))')
 OR len(list_filter(fractions, lambda x: CAST(x[2] AS DOUBLE) <> 0 AND CAST(x[1] AS DOUBLE) = 12 * CAST(x[2] AS DOUBLE))) > 0
 OR regexp_matches(t, '(^|[^{WORD}])twelve($|[^{WORD}])')""")
def number_mentions(spark, d):
    """Prompts that state the value 12 in any form."""
    c = F.col("canonical_prompt")
    return table(spark, d, "inventory").where(answers.mentions_number(c, F.lit("12"))).select("record_no")


# Checklists and scores

_CHECK_SQL = {
    "has_why": "contains(l, 'why') OR contains(l, 'because') OR contains(l, 'valid') OR contains(l, 'so that')",
    "names_mistake": "contains(l, 'mistake') OR contains(l, 'wrong') OR contains(l, 'error') OR contains(l, 'line')",
    "has_hint": "contains(l, 'hint') OR contains(l, 'recompute') OR contains(l, 'rewrite') OR contains(l, 'divide')",
    "mentions_turbine": "contains(l, 'turbine')",
    "mentions_energy": "contains(l, 'energy')",
    "mentions_force_or_power": "contains(l, 'force') OR contains(l, 'power')",
    "has_analogy": "contains(l, 'analogy') OR contains(l, 'like ') OR contains(l, 'think of') OR contains(l, 'similar')",
    "has_misconception": "contains(l, 'misconception') OR contains(l, 'common mistake') OR contains(l, 'people think')",
    "limiting_oxygen": "contains(l, 'oxygen') OR contains(l, 'o2')",
    "line1_or_distribute": "contains(l, 'line 1') OR contains(l, 'distribut')",
    "velocity_zero": "contains(l, 'velocity') AND contains(l, 'zero')",
    "accel_nonzero": "contains(l, 'acceleration') AND (contains(l, 'not zero') OR contains(l, 'nonzero') OR contains(l, 'non-zero') OR contains(l, 'still') OR contains(l, 'gravity'))",
    "completing_square": "contains(l, 'complet') AND contains(l, 'square')",
    "has_final_formula": "contains(l, '2a') AND (contains(l, 'b^2') OR contains(l, 'b²') OR contains(l, 'discriminant'))",
    "no_markup": "NOT regexp_matches(t, '####|<<[^>]*>>')",
    "has_question": "contains(t, '?')",
    "has_two_questions": "length(t) - length(replace(t, '?', '')) >= 2",
    "no_final_x": r"NOT regexp_matches(l, '\bx\s*=\s*-?[0-9]')",
    "no_final_a": r"NOT regexp_matches(l, '\ba\s*=\s*-?[0-9]')",
    "co2_33": r"regexp_matches(t, '\b33\b')",
}


@query(
    "WITH d AS (SELECT coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents) "
    + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {v}) AS met FROM d" for k, v in _CHECK_SQL.items())
)
def checklist_counts(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(*(F.count_if(f(F.coalesce("text", F.lit("")))).alias(k) for k, f in checklist.CHECKS.items()))
    return n.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(k).alias("met")) for k in checklist.CHECKS))))


@query("""
WITH s AS (SELECT behavior, NOT regexp_matches(coalesce(text, ''), '####|<<[^>]*>>') AS a, contains(coalesce(text, ''), '?') AS b FROM documents)
SELECT behavior, count(*) AS n, round(avg(CASE WHEN a AND b THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(avg(CASE WHEN a THEN 0.0 ELSE 1 END), 6) AS leak_rate FROM s GROUP BY behavior""")
def checklist_by_behavior(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "behavior", F.col("text").alias("pred"), F.array(F.lit("no_markup"), F.lit("has_question")).alias("checks"))
    each = scoring.checked(docs, keep=("behavior",))
    return each.groupBy("behavior").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.col("markup_leak").cast("double")), 6).alias("leak_rate"))


@query("""
SELECT subject, count(*) AS n, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) > 20) AS correct FROM documents GROUP BY subject""")
def soft_accuracy(spark, d):
    docs = table(spark, d, "documents")
    return scoring.accuracy(docs, scoring.long_enough(F.col("text"), F.lit("asked")), "subject").drop("acc")


@query("""
WITH p AS (SELECT item_id, upper(left(trim(text), 1)) AS letter, upper(left(behavior, 1)) AS gold, suite FROM eval_items)
SELECT suite, count(*) AS n, count(*) FILTER (WHERE letter = gold) AS correct, round(count(*) FILTER (WHERE letter = gold) / count(*), 6) AS acc FROM p GROUP BY suite""")
def choice_accuracy(spark, d):
    items = table(spark, d, "eval_items")
    return scoring.accuracy(items, scoring.choice_correct(F.col("text"), F.col("behavior")), "suite").withColumn("acc", F.round("acc", 6))


@query("""
WITH m AS (SELECT source, subject, avg(length(text)) AS m, sum(length(text)) AS s, count(text) AS n FROM documents GROUP BY ALL)
SELECT round(avg(m), 4) AS macro, round(sum(s) / sum(n), 4) AS micro FROM m""")
def macro_micro(spark, d):
    docs = table(spark, d, "documents").withColumn("v", F.length("text").cast("double"))
    out = scoring.macro_micro(docs, "v", "source", "subject")
    return out.select(F.round("macro", 4).alias("macro"), F.round("micro", 4).alias("micro"))


_COMPOSITE = "0.3 * 100.0 * least(1.0, p_size / 15.0) + 0.2 * greatest(0.0, least(100.0, 100.0 * (7.0 - 4 * p_retailprice / 1024.0) / 7.0))"


@query(f"SELECT p_partkey, round({_COMPOSITE}, 4) AS composite FROM part WHERE 4 * p_retailprice <= 7000 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 ORDER BY round({_COMPOSITE}, 2) DESC, p_partkey LIMIT 1")
def composite_winner(spark, d):
    """Over profiles of which some have no or a zero memory measure, which don't fit the budget."""
    rss = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(4 * F.col("p_retailprice"))
    profiles = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("tps"), rss.alias("peak_rss_mb"), F.lit(None).cast("double").alias("arc"))
    best = scoring.winner(scoring.composite(profiles), "p_partkey")
    return best.select("p_partkey", F.round("composite", 4).alias("composite"))


@query("""
WITH b AS (SELECT p_brand, max(p_size) AS size, round(min(p_retailprice), 2) AS price, count(*) AS n FROM part GROUP BY p_brand)
SELECT p_brand, size, price, n FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.size >= b.size AND o.n >= b.n AND o.price <= b.price AND (o.size > b.size OR o.n > b.n OR o.price < b.price))""")
def pareto_front(spark, d):
    b = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"), F.round(F.min("p_retailprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"))
    return scoring.pareto(b, ["size", "n"], ["price"])


@query("""
SELECT p_brand, avg(p_size) FILTER (WHERE p_type LIKE 'S%') IS NOT NULL AS has_before, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS deviation, count(*) AS runs, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY p_brand""")
def repeated_runs(spark, d):
    part = table(spark, d, "part")
    stats = scoring.repeated_runs(part, "p_retailprice", "p_brand")
    has = part.groupBy("p_brand").agg(F.bool_or(F.col("p_type").startswith("S")).alias("has_before"))
    return stats.join(has, "p_brand").select("p_brand", "has_before", "runs", *(F.round(c, 4).alias(c) for c in ("mean", "deviation", "median")))


@query("""
SELECT l_linestatus, max(CASE WHEN l_returnflag = 'R' THEN q END) AS before, max(CASE WHEN l_returnflag = 'N' THEN q END) AS after, round(max(CASE WHEN l_returnflag = 'N' THEN q END) - max(CASE WHEN l_returnflag = 'R' THEN q END), 4) AS delta
FROM (SELECT l_linestatus, l_returnflag, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""")
def version_delta(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("q"))
    return scoring.delta(q, ["l_linestatus"], "l_returnflag", "R", "N", "q").withColumn("delta", F.round("delta", 4))


@query("""
WITH s AS (SELECT round(l_discount, 2) AS score, count(*) AS n, count(*) FILTER (WHERE l_tax >= 0.02) AS k FROM lineitem GROUP BY 1),
r AS (SELECT score, sum(k) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS p FROM s)
SELECT min(score) AS threshold FROM r WHERE p >= 0.5""")
def precision_threshold(spark, d):
    rows = table(spark, d, "lineitem").select(F.round("l_discount", 2).alias("score"), (F.col("l_tax") >= 0.02).alias("ok"))
    return scoring.precision_threshold(rows, "score", "ok", 0.5)


@query("""
SELECT DISTINCT u.c AS check FROM (SELECT unnest(rubric_dimensions) AS c FROM balanced_tutoring_v8) u WHERE u.c NOT IN (SELECT DISTINCT behavior FROM eval_items)""")
def rubric_missing(spark, d):
    rubric = table(spark, d, "eval_items").select(F.col("behavior").alias("name")).distinct()
    return firewall.missing_checks(table(spark, d, "balanced_tutoring_v8"), rubric, "rubric_dimensions")


@query(f"""
WITH e AS (SELECT suite, item_id, text FROM eval_items)
SELECT suite AS path, count(*) AS rows, count(*) FILTER (WHERE length(text) > 0) AS prompts_hashed FROM e GROUP BY suite""")
def frozen_file_stats(spark, d):
    return firewall.file_stats(table(spark, d, "eval_items").select(F.col("suite").alias("path"), F.col("text").alias("prompt")))


# Mix construction


@query("""
SELECT doc_id, CASE o % 4 WHEN 0 THEN 'solve' WHEN 1 THEN 'explain' WHEN 2 THEN 'hint' ELSE 'first_error' END AS behavior, 'doc_' || lpad(CAST(o AS VARCHAR), CAST(greatest(5, length(CAST(o AS VARCHAR))) AS INTEGER), '0') AS id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)""")
def round_robin_behavior(spark, d):
    rows = ordinal.with_ordinal(table(spark, d, "documents").select("doc_id"), "doc_id")
    return ordinal.assign_cycle(rows, ["solve", "explain", "hint", "first_error"]).select("doc_id", "behavior", ordinal.ordinal_id("doc").alias("id"))


@query("""
SELECT behavior, item_id, row_number() OVER (PARTITION BY behavior ORDER BY item_id) - 1 AS ordinal FROM eval_items""")
def ordinal_per_behavior(spark, d):
    return ordinal.with_ordinal_by(table(spark, d, "eval_items").select("behavior", "item_id"), ["behavior"], "item_id")


@query("""
SELECT doc_id, o AS ordinal FROM (SELECT doc_id, trim(text) AS t, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE t <> '' ORDER BY o LIMIT 100""")
def filtered_limit(spark, d):
    """The first 100 documents with text, numbered with the dropped ones: the limit is the feature."""
    rows = ordinal.with_ordinal(table(spark, d, "documents").select("doc_id", F.trim("text").alias("t")), "doc_id")
    return ordinal.kept_limit(rows, F.coalesce(F.col("t") != "", F.lit(False)), 100).select("doc_id", "ordinal")


def _mix(spark, d) -> DataFrame:
    inv = table(spark, d, "inventory").select("record_no", F.col("canonical_prompt").alias("question"))
    worked = mix.from_solutions(ordinal.with_ordinal(inv, "record_no").withColumn("answer", F.concat(F.lit("a = <<1+2=3>>3\n#### "), (F.col("record_no") % 7).cast("string"))))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.col("subject").alias("correct_answer"), F.col("source").alias("support"))
    return mix.union(worked, mix.from_science(ordinal.with_ordinal(docs, "doc_id")))


@query("""
WITH w AS (SELECT CASE (row_number() OVER (ORDER BY record_no) - 1) % 4 WHEN 0 THEN 'solve' WHEN 1 THEN 'explain' WHEN 2 THEN 'hint' ELSE 'first_error' END AS behavior, 'worked_train' AS source FROM inventory),
s AS (SELECT CASE o % 3 WHEN 0 THEN 'solve' WHEN 1 THEN 'explain' ELSE 'hint' END AS behavior, 'science_train' AS source
      FROM (SELECT subject, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE coalesce(trim(subject), '') <> ''),
m AS (SELECT * FROM w UNION ALL SELECT * FROM s)
SELECT 'all' AS grouping_name, NULL AS grouping_value, count(*) AS row_count FROM m UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY source
UNION ALL SELECT 'behavior', behavior, count(*) FROM m GROUP BY behavior UNION ALL SELECT 'direction', 'en_en', count(*) FROM m""")
def mix_union_counts(spark, d):
    return mix.counts(_mix(spark, d), "source", "behavior", "direction")


@query("""
WITH w AS (SELECT CASE (row_number() OVER (ORDER BY record_no) - 1) % 4 WHEN 0 THEN 'solve' WHEN 1 THEN 'explain' WHEN 2 THEN 'hint' ELSE 'first_error' END AS behavior FROM inventory)
SELECT behavior, v AS variant, count(*) AS n FROM w, (VALUES ('base'), ('concise'), ('checklist')) t(v) WHERE v <> 'checklist' OR behavior <> 'solve' GROUP BY ALL""")
def mix_variants(spark, d):
    rows = _mix(spark, d).where("source = 'worked_train'").drop("part")
    return mix.with_variants(rows).groupBy("behavior", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS leaks FROM documents WHERE regexp_matches(text, '####|<<[^>]*>>')")
def markup_leaks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return mix.leaks(docs).agg(F.count(F.lit(1)).alias("leaks"))


@query(f"""
SELECT source, count(*) AS kept FROM documents WHERE text IS NULL OR {norm0('text')} NOT IN (SELECT {norm0('text')} FROM eval_items) GROUP BY source""")
def mix_without_evaluation(spark, d):
    docs = table(spark, d, "documents").select("source", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return mix.without_evaluation(docs, table(spark, d, "eval_items")).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query("""
SELECT item_id, 'SYSTEM: ' || subject || chr(10) || 'USER: ' || text || chr(10) || 'ASSISTANT: ' || behavior || chr(10) AS chat, true AS valid FROM eval_items""")
def rendered_chats(spark, d):
    m = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", "subject"), ("user", "text"), ("assistant", "behavior"))))
    return table(spark, d, "eval_items").select("item_id", prompts.render_chat(m).alias("chat"), prompts.valid_role_order(m).alias("valid"))


@query("SELECT item_id, text AS v1, text AS v0, subject AS gold FROM eval_items")
def extracted_prompts(spark, d):
    record = F.to_json(F.struct("item_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    raw = F.to_json(F.struct(F.col("subject").alias("target")))
    return table(spark, d, "eval_items").select("item_id", prompts.prompt_v1(record).alias("v1"), prompts.prompt_v0(record).alias("v0"), prompts.gold_answer(F.lit(" "), raw).alias("gold"))


# Provenance and census

_REASONS = f"""{FROZEN},
d AS (SELECT i.*, s.id AS sid, list_filter([
  CASE WHEN s.id IS NULL THEN 'unknown_source' END,
  CASE WHEN s.id IS NOT NULL AND NOT s.allowed_use THEN 'source_not_approved' END,
  CASE WHEN s.id IS NOT NULL AND coalesce(s.revision, '') = '' THEN 'revision_not_pinned' END,
  CASE WHEN s.id IS NOT NULL AND i.source_split IS DISTINCT FROM s.imported_split THEN 'split_mismatch' END,
  CASE WHEN i.grade_band IS DISTINCT FROM 'secondary_9_12' THEN 'outside_target_grade' END,
  CASE WHEN s.id IS NOT NULL AND i.license_class IS DISTINCT FROM s.license_class THEN 'license_class_mismatch' END,
  CASE WHEN NOT coalesce(i.hard_gate_pass, false) THEN 'hard_gate_failed' END], lambda x: x IS NOT NULL) AS gates
  FROM inventory i LEFT JOIN sources s ON s.id = i.source_id),
r AS (SELECT d.*, list_concat(coalesce(rejection_reasons, []), gates, list_filter([CASE WHEN exact_match THEN 'exact_eval_overlap' END, CASE WHEN template_match THEN 'template_eval_overlap' END], lambda x: x IS NOT NULL)) AS reasons
  FROM d JOIN firewall_ USING (record_no))"""


def _decided(spark, d) -> DataFrame:
    """The census's decisions, every record also checked against the frozen evaluation."""
    checked = _checked(spark, d, F.lit(True)).select("record_no", F.col("decision.reasons").alias("reasons"))
    out = census.decided(table(spark, d, "inventory"), table(spark, d, "sources"), checked, strict=False)
    return scratch.stored(out.drop("canonical_prompt"), "decided")  # several aggregates read it


@query(f"WITH {_REASONS} SELECT record_no, array_to_string(reasons, ',') AS reasons FROM r")
def reason_arrays(spark, d):
    return _decided(spark, d).select("record_no", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_REASONS} SELECT reason, count(*) AS row_count FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def reason_counts(spark, d):
    return census.reason_counts(_decided(spark, d))


_CELLS = """
b AS (SELECT source_id, family_id, subject, grounding_available, unnest(eligible_behaviors) AS behavior FROM r WHERE len(reasons) = 0),
c AS (SELECT subject, behavior, count(DISTINCT family_id) AS n FROM b WHERE behavior = 'solve' OR grounding_available GROUP BY ALL),
spine AS (SELECT * FROM (VALUES ('math'), ('physics'), ('chemistry'), ('biology'), ('earth_science')) s(subject), (VALUES ('solve'), ('explain'), ('hint'), ('diagnose')) t(behavior))"""


@query(f"""WITH {_REASONS}, {_CELLS}
SELECT spine.subject, spine.behavior, coalesce(n, 0) AS families, greatest(400 - coalesce(n, 0), 0) AS gap, CASE WHEN coalesce(n, 0) >= 400 THEN 'ready' ELSE 'short' END AS status
FROM spine LEFT JOIN c USING (subject, behavior)""")
def census_cells(spark, d):
    return census.cells(_decided(spark, d)).select("subject", "behavior", "families", "gap", "status")


@query(f"""WITH {_REASONS}, {_CELLS}
SELECT subject, behavior, source_id, count(DISTINCT family_id) AS n FROM b WHERE behavior = 'solve' OR grounding_available
GROUP BY ALL HAVING subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')""")
def census_cells_by_source(spark, d):
    return census.cells(_decided(spark, d)).select("subject", "behavior", F.explode("by_source").alias("source_id", "n"))


@query(f"""WITH {_REASONS}
SELECT s.id AS source_id, count(r.record_no) AS inventory_rows, count(DISTINCT CASE WHEN len(r.reasons) = 0 THEN r.family_id END) AS counted_families, count(*) FILTER (WHERE len(r.reasons) > 0) AS rejected_rows
FROM sources s LEFT JOIN r ON r.source_id = s.id GROUP BY s.id""")
def census_by_source(spark, d):
    return census.by_source(_decided(spark, d), table(spark, d, "sources"))


@query(f"""WITH {_REASONS}, {_CELLS}, f AS (SELECT coalesce(n, 0) >= 400 AS ready FROM spine LEFT JOIN c USING (subject, behavior))
SELECT (SELECT count(*) FROM inventory) AS inventory_rows_seen, (SELECT count(*) FROM sources WHERE allowed_use) AS approved_sources,
  (SELECT count(*) FROM f WHERE ready) AS ready_cells, (SELECT count(*) FROM f WHERE NOT ready) AS short_cells, (SELECT bool_and(ready) FROM f) AS all_ready,
  (SELECT CASE WHEN bool_and(ready) THEN 'go' ELSE 'blocked_short_cells' END FROM f) AS supply_decision""")
def census_summary(spark, d):
    return census.summary(_decided(spark, d), table(spark, d, "sources"))


@query(f"""WITH {_REASONS}, {_CELLS}
SELECT spine.subject, spine.behavior, CASE WHEN coalesce(n, 0) >= 400 THEN '' ELSE 'pin and approve more sources; import records that pass the gates; add structured sources before any generation' END AS remediation
FROM spine LEFT JOIN c USING (subject, behavior)""")
def census_remediation(spark, d):
    return census.cells(_decided(spark, d)).select("subject", "behavior", F.array_join("remediation", "; ").alias("remediation"))


@query(f"""WITH {_REASONS}, {_CELLS}, f AS (SELECT coalesce(n, 0) >= 400 AS ready FROM spine LEFT JOIN c USING (subject, behavior))
SELECT 'A' AS phase, 13 AS schema_fields, (SELECT count(*) FROM sources) AS source_count, 3 AS registry_tables,
  (SELECT count(*) FROM source_records) + (SELECT count(*) FROM training_rows) + (SELECT count(*) FROM build_membership) AS registry_rows,
  (SELECT count(*) FROM inventory) AS inventory_rows_seen, (SELECT count(*) FROM f WHERE ready) AS ready_cells, (SELECT count(*) = 20 FROM f) AS tooling_complete, (SELECT bool_and(ready) FROM f) AS may_start""")
def gate_a(spark, d):
    rows = registry.counts({n: table(spark, d, n) for n in registry.TABLES})
    fields = len(spark.createDataFrame([], rules.CANONICAL).columns)
    out = census.gate_a(_decided(spark, d), table(spark, d, "sources"), rows, fields)
    return out.select("phase", "schema_fields", "source_count", "registry_tables", "registry_rows", "inventory_rows_seen", "ready_cells", "tooling_complete", "may_start")


# Validation


@query("""
SELECT record_no, 'subject' AS location, CASE WHEN subject IS NULL THEN 'missing' ELSE 'literal_error' END AS kind FROM inventory
WHERE subject IS NULL OR subject NOT IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')""")
def inventory_issues(spark, d):
    return rules.issues(table(spark, d, "inventory"), rules.inventory_rules(), ["record_no"]).select("record_no", "location", "kind")


@query("""
SELECT count(*) AS records_seen, count(*) FILTER (WHERE subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')) AS records_valid,
  count(*) - count(*) FILTER (WHERE subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')) AS issue_count,
  count(*) = count(*) FILTER (WHERE subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')) AS valid FROM inventory""")
def inventory_report(spark, d):
    return rules.report(table(spark, d, "inventory"), rules.inventory_rules())


@query("""
SELECT id, 'license_class' AS location, 'missing' AS kind FROM sources WHERE license_class IS NULL
UNION ALL SELECT id, '', 'value_error' FROM sources WHERE license_class IS NOT NULL AND allowed_use AND
  (coalesce(revision, '') = '' OR review_status <> 'approved' OR license_class IN ('unknown', 'excluded') OR export_profile = 'excluded')""")
def source_issues(spark, d):
    return rules.issues(table(spark, d, "sources"), rules.source_rules(), ["id"]).select("id", "location", "kind")


@query("SELECT source_key, count(*) AS copies FROM source_records WHERE source_key IS NOT NULL GROUP BY source_key HAVING count(*) > 1")
def repeated_source_keys(spark, d):
    return rules.duplicates(table(spark, d, "source_records"), "source_key")


# Registry


def _extra(keys: str, t: str) -> str:
    nulls = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t} WHERE {nulls} GROUP BY {keys}))"


_DANGLING = "(SELECT count(*) FROM {t} x WHERE x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT {k} FROM {u} WHERE {k} IS NOT NULL))"


_PRESENT = " ".join(f"UNION ALL SELECT '{c.name}', (SELECT count(*) FROM {c.table} WHERE {c.broken})" for c in registry.CONSTRAINTS if c.name.endswith("_present"))


@query(f"""
SELECT unnest(['source_records_key', 'training_rows_key', 'training_rows_variant', 'build_membership_key', 'training_rows_source', 'training_rows_duplicate', 'build_membership_row', 'build_membership_value', 'build_membership_exposure']) AS constraint_name,
 unnest([{_extra('source_key', 'source_records')}, {_extra('row_id', 'training_rows')}, {_extra('family_id, selected_behavior, constraint_signature, renderer_version', 'training_rows')}, {_extra('build_name, row_id, membership', 'build_membership')},
 {_DANGLING.format(t='training_rows', c='source_key', k='source_key', u='source_records')}, {_DANGLING.format(t='training_rows', c='duplicate_of', k='row_id', u='training_rows')}, {_DANGLING.format(t='build_membership', c='row_id', k='row_id', u='training_rows')},
 (SELECT count(*) FROM build_membership WHERE membership NOT IN ('qa_pilot', 'mini_train', 'full', 'evaluation')), (SELECT count(*) FROM build_membership WHERE exposure_count < 0)]::BIGINT[]) AS violations {_PRESENT}""")
def registry_violations(spark, d):
    return registry.violations({n: table(spark, d, n) for n in ("source_records", "training_rows", "build_membership")})


@query("SELECT 'source_records' AS table_name, count(*) AS row_count FROM source_records UNION ALL SELECT 'training_rows', count(*) FROM training_rows UNION ALL SELECT 'build_membership', count(*) FROM build_membership")
def registry_counts(spark, d):
    return registry.counts({n: table(spark, d, n) for n in ("source_records", "training_rows", "build_membership")})


@query("""
WITH r AS (SELECT build_name, row_id, sum(greatest(coalesce(exposure_count, 0), 0)) AS e, count(DISTINCT CASE WHEN exposure_count > 0 THEN lower(trim(membership)) END) AS m FROM build_membership GROUP BY ALL)
SELECT build_name, count(*) AS row_count, sum(e)::BIGINT AS exposures, count(*) FILTER (WHERE m > 1) AS twice FROM r GROUP BY build_name""")
def exposure_accounting(spark, d):
    return registry.exposures(table(spark, d, "build_membership"))


# Selection


@query("""
SELECT line_no FROM (SELECT line_no, row_number() OVER (PARTITION BY family_id ORDER BY created_at NULLS FIRST, line_no) AS r FROM training_rows) WHERE r <= 2""")
def family_cap(spark, d):
    return selection.family_cap(table(spark, d, "training_rows"), ["family_id"], [F.col("created_at").asc_nulls_first(), F.col("line_no")]).select("line_no")


@query("""
SELECT line_no, retained, line_no <> retained AS is_duplicate
FROM (SELECT line_no, CASE WHEN canonical_content_hash IS NOT NULL THEN first_value(line_no) OVER (PARTITION BY canonical_content_hash ORDER BY created_at NULLS LAST, line_no DESC) END AS retained FROM training_rows)""")
def retained_rows(spark, d):
    """Of rows with one content the earliest, of equal times the last line."""
    rows = selection.representatives(table(spark, d, "training_rows"), ["canonical_content_hash"], "line_no", [F.col("created_at").asc_nulls_last(), F.col("line_no").desc()])
    return rows.select("line_no", "retained", "is_duplicate")


@query("""
WITH n AS (SELECT subject, source_id, count(*) AS n FROM inventory WHERE subject IS NOT NULL GROUP BY ALL)
SELECT subject, source_id, n, round(n / sum(n) OVER (PARTITION BY subject), 6) AS share, n / sum(n) OVER (PARTITION BY subject) > 0.1 AS over FROM n""")
def share_caps(spark, d):
    inv = table(spark, d, "inventory").where("subject is not null")
    return selection.share_caps(inv, ["subject"], "source_id", 0.1).withColumn("share", F.round("share", 6))


@query("""
WITH q AS (SELECT subject, min(minimum_examples) AS quota FROM balanced_tutoring_v8 GROUP BY subject)
SELECT record_no FROM (SELECT record_no, subject, row_number() OVER (PARTITION BY subject ORDER BY length(canonical_prompt) DESC, record_no) AS r FROM inventory) i JOIN q USING (subject) WHERE r <= quota""")
def quota_selection(spark, d):
    plan = table(spark, d, "balanced_tutoring_v8")
    quota = plan.groupBy("subject").agg(F.min("minimum_examples").alias("quota"))
    most = quota.agg(F.max("quota")).first()[0] or 0
    return selection.fill_quotas(table(spark, d, "inventory"), ["subject"], quota, [F.length("canonical_prompt").desc(), F.col("record_no")], most).select("record_no")


@query("SELECT least(min(n), 500) AS size, least(min(n), 500) >= 400 AS enough FROM (SELECT count(*) AS n FROM inventory WHERE subject IS NOT NULL GROUP BY subject)")
def balanced_resize(spark, d):
    n = table(spark, d, "inventory").where("subject is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return selection.balanced_size(n)


@query("""
SELECT record_no FROM (SELECT record_no, row_number() OVER (PARTITION BY source_id, grade_band ORDER BY md5(CAST(record_no AS VARCHAR)), record_no) AS r, count(*) OVER (PARTITION BY source_id, grade_band) AS n FROM inventory) WHERE r <= greatest(ceil(n * 0.1), 1)""")
def stratified_review(spark, d):
    return selection.stratified_sample(table(spark, d, "inventory"), ["source_id", "grade_band"], "record_no", 0.1).select("record_no")


@query("""
WITH u AS (SELECT family_id, CAST('0x' || left(sha256('0:' || family_id), 8) AS BIGINT) / 4294967296.0 AS u FROM training_rows)
SELECT CASE WHEN family_id IS NULL THEN NULL WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS row_count, count(DISTINCT family_id) AS families FROM u GROUP BY 1""")
def family_splits(spark, d):
    rows = table(spark, d, "training_rows").select("family_id", selection.hash_split(F.col("family_id")).alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("family_id").alias("families"))


@query("""
SELECT 'family_present' AS gate, count(*) FILTER (WHERE family_id IS NULL) AS violations, count(*) FILTER (WHERE family_id IS NULL) = 0 AS passed FROM training_rows
UNION ALL SELECT 'known_behavior', count(*) FILTER (WHERE selected_behavior NOT IN ('solve', 'explain', 'hint', 'diagnose')), count(*) FILTER (WHERE selected_behavior NOT IN ('solve', 'explain', 'hint', 'diagnose')) = 0 FROM training_rows
UNION ALL SELECT 'hash_form', count(*) FILTER (WHERE NOT regexp_full_match(canonical_content_hash, 'sha256:[0-9a-f]{64}')), count(*) FILTER (WHERE NOT regexp_full_match(canonical_content_hash, 'sha256:[0-9a-f]{64}')) = 0 FROM training_rows
UNION ALL SELECT 'no_self_duplicate', count(*) FILTER (WHERE duplicate_of = row_id), count(*) FILTER (WHERE duplicate_of = row_id) = 0 FROM training_rows""")
def build_gates(spark, d):
    c = F.col
    gates = {
        "family_present": c("family_id").isNull(),
        "known_behavior": ~c("selected_behavior").isin(*vocab.BEHAVIORS),
        "hash_form": ~c("canonical_content_hash").rlike(r"^sha256:[0-9a-f]{64}\z"),
        "no_self_duplicate": c("duplicate_of") == c("row_id"),
    }
    return selection.build_gates(table(spark, d, "training_rows"), gates)


@query("SELECT left(text, 20) AS opening, count(*) AS n FROM documents WHERE left(text, 20) <> '' GROUP BY 1 HAVING count(*) >= 5")
def boilerplate_openings(spark, d):
    return selection.boilerplate(table(spark, d, "documents"), F.col("text"), 20, 5)


@query("""
SELECT row_id FROM (SELECT DISTINCT row_id FROM build_membership WHERE lower(trim(membership)) = 'full'
UNION SELECT DISTINCT row_id FROM build_membership WHERE lower(trim(membership)) = 'evaluation')""")
def combined_builds(spark, d):
    m = table(spark, d, "build_membership").withColumn("m", F.lower(F.trim("membership")))
    return selection.combine(m.where("m = 'full'").select("row_id"), m.where("m = 'evaluation'").select("row_id"), "row_id")


@query("""
SELECT source_id, round(sum(CASE WHEN grade_band = 'tertiary' THEN 0.1 / r ELSE 0.9 / f END), 6) AS weight FROM inventory,
 (SELECT count(*) FILTER (WHERE grade_band = 'tertiary') AS r, count(*) FILTER (WHERE grade_band IS DISTINCT FROM 'tertiary') AS f FROM inventory) GROUP BY source_id""")
def replay_weights(spark, d):
    w = selection.replay_weights(table(spark, d, "inventory"), F.col("grade_band") == "tertiary")
    return w.groupBy("source_id").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT event_type AS stage, count(*) AS calls, sum(user_id)::BIGINT AS tokens, round(sum(value), 2) AS cost FROM events GROUP BY event_type")
def budget_rollup(spark, d):
    return selection.budget(table(spark, d, "events"), "event_type", "user_id", "value").withColumnRenamed("event_type", "stage").withColumn("cost", F.round("cost", 2))


@query("SELECT export_profile, count(*) AS row_count, count(DISTINCT record_no) AS records FROM inventory i JOIN sources s ON s.id = i.source_id GROUP BY export_profile")
def license_segments(spark, d):
    """The inventory written in one folder a license profile, and what is in each."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "export_profile")
    to = f"{scratch.root(spark)}/by-license-{uuid.uuid4().hex}"
    sinks.write_by_license(table(spark, d, "inventory").join(small(s), "source_id").select("record_no", "export_profile"), to)
    return spark.read.parquet(to).groupBy("export_profile").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("record_no").alias("records"))


# Events


def _runs(spark, d) -> DataFrame:
    """The events table as run logs: a run a user, clicks and views opening and closing items of three keys, errors and
    purchases closing them, and sign-ups of values above 95 finishing the run, some with a status of their own."""
    e = table(spark, d, "events")
    kinds = {"click": "item_start", "view": "item_ok", "error": "item_error", "purchase": "item_skip"}
    name = F.when((F.col("event_type") == "signup") & (F.col("value") > 95), "run_finish")
    for k, v in kinds.items():
        name = name.when(F.col("event_type") == k, v)
    key, given = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.when(F.col("value") > 150, "stopped")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), name.otherwise("info").alias("event"), key.alias("key"), F.when(name == "run_finish", given).alias("status"))


_RUNS = """
e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, 'k' || (event_id % 3) AS key, value,
  CASE WHEN event_type = 'signup' AND value > 95 THEN 'finish' WHEN event_type = 'click' THEN 'start' WHEN event_type = 'view' THEN 'ok' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'skip' END AS e FROM events),
fin AS (SELECT run_id, min(seq) AS at, (SELECT CASE WHEN x.value > 150 THEN 'stopped' END FROM e x WHERE x.run_id = e.run_id AND x.e = 'finish' ORDER BY x.seq LIMIT 1) AS given FROM e WHERE e = 'finish' GROUP BY run_id),
live AS (SELECT e.* FROM e LEFT JOIN fin USING (run_id) WHERE e.e IS NOT NULL AND (fin.at IS NULL OR e.seq <= fin.at)),
s AS (SELECT run_id, seq, key, lead(seq) OVER (PARTITION BY run_id ORDER BY seq) AS nx FROM live WHERE e = 'start'),
o AS (SELECT s.run_id, s.seq, s.nx, (SELECT count(*) FROM live c WHERE c.run_id = s.run_id AND c.e IN ('ok', 'error', 'skip') AND c.key = s.key AND c.seq > s.seq AND (s.nx IS NULL OR c.seq < s.nx)) AS closed FROM s),
i AS (SELECT run_id, count(*) AS interrupted FROM o WHERE closed = 0 AND (nx IS NOT NULL OR run_id IN (SELECT run_id FROM fin)) GROUP BY run_id),
a AS (SELECT run_id, count(*) FILTER (WHERE e = 'ok') AS ok, count(*) FILTER (WHERE e = 'error') AS error, count(*) FILTER (WHERE e = 'skip') AS skipped FROM live GROUP BY run_id),
n AS (SELECT r.run_id, coalesce(ok, 0) AS ok, coalesce(error, 0) AS error, coalesce(skipped, 0) AS skipped, coalesce(interrupted, 0) AS interrupted, fin.at IS NOT NULL AS over, fin.given
  FROM (SELECT DISTINCT run_id FROM e) r LEFT JOIN a USING (run_id) LEFT JOIN i USING (run_id) LEFT JOIN fin USING (run_id))"""
_ROLLUP = f"""WITH {_RUNS} SELECT run_id, ok, error, skipped, interrupted, ok + error + skipped + interrupted AS total,
 CASE WHEN NOT over THEN 'running' WHEN given IS NOT NULL THEN given WHEN error > 0 AND ok > 0 THEN 'partial' WHEN error > 0 THEN 'error' WHEN interrupted > 0 THEN 'interrupted' ELSE 'ok' END AS status, NOT over AS partial FROM n"""


@query(_ROLLUP)
def runlog_rollup(spark, d):
    return runlog.rollup(_runs(spark, d))


@query(_ROLLUP)
def runlog_stream(spark, d):
    """The same from a stream: events appended to files in two batches, rolled up with state, the last row of each run."""
    base = f"{scratch.root(spark)}/stream-{uuid.uuid4().hex}"
    log = _runs(spark, d)
    middle = log.agg(F.avg("seq")).first()[0] or 0

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    spark.createDataFrame([], runlog.EVENTS).write.json(f"{base}/events")
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        runlog.append_events(log.where(part), f"{base}/events")
        rolled = runlog.rollup_stream(runlog.read_events(spark, f"{base}/events"), late="3650 days")
        rolled.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    columns = ["run_id", *runlog.STATUSES[:4], "total", "status", "partial"]
    out = spark.read.schema("run_id string, ok bigint, error bigint, skipped bigint, interrupted bigint, total bigint, status string, partial boolean, batch int").parquet(f"{base}/out")
    return out.groupBy("run_id").agg(F.max_by(F.struct(*columns[1:]), "batch").alias("r")).select("run_id", "r.*")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark, d):
    out = runlog.windowed_counts(table(spark, d, "events"), window="1 hour")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT event_id AS seq, '[events] ' || CASE WHEN event_type = 'signup' AND value > 95 THEN 'DONE' || CASE WHEN value > 150 THEN ' stopped' ELSE '' END
  ELSE CASE event_type WHEN 'click' THEN 'START k' || (event_id % 3) WHEN 'view' THEN 'OK k' || (event_id % 3) WHEN 'error' THEN 'FAIL k' || (event_id % 3) WHEN 'purchase' THEN 'SKIP k' || (event_id % 3) ELSE 'INFO' END END || ' (seq=' || event_id || ')' AS line FROM events""")
def log_lines(spark, d):
    e = _runs(spark, d)
    line = runlog.log_line(F.lit("events"), F.col("event"), F.col("key"), F.col("status"), F.lit(None).cast("string"), F.create_map(F.lit("seq"), F.col("seq").cast("string")))
    return e.select("seq", line.alias("line"))


# Embeddings


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id, list_cosine_similarity(q.e, x.embedding::DOUBLE[]) AS c FROM q, embeddings x WHERE x.vec_id <> q.vec_id)
SELECT query_id, neighbor_id, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, neighbor_id) AS r FROM s) WHERE r <= 5""")
def semantic_neighbors(spark, d):
    """The five nearest rows (a top-k) of every query, the rows with an id divisible by 50, among all rows."""
    e = table(spark, d, "embeddings")
    return neighbors.cosine_neighbors(e.where("vec_id % 50 = 0"), e).withColumn("cosine", F.round("cosine", 5))


from sedgeline.plans import files, records  # noqa: E402, F401  the rest of the catalogue
