"""SQL twins of the training-data queries, for DuckDB: written from the definitions, without filters, chunks or vectors."""

from __future__ import annotations

from sedgeline.plans.base import folded, nfkc, split_name

_SUBJECT = r"""CASE WHEN {s} IN ('math', 'maths', 'mathematics') THEN 'math' WHEN {s} IN ('physics', 'phys') THEN 'physics' WHEN {s} IN ('chemistry', 'chem') THEN 'chemistry' WHEN {s} IN ('biology', 'bio') THEN 'biology'
 WHEN {s} IN ('earth_science', 'earth_sciences', 'earthscience', 'geoscience', 'earth') THEN 'earth_science' ELSE {s} END"""

_SPELLED = r"regexp_replace(lower(trim(subject)), '[\s_-]+', '_', 'g')"


def _hex(c: str) -> str:
    return f"nullif(regexp_extract(lower({c}), '[0-9a-f]{{64}}'), '')"


def squeezed(c: str) -> str:
    """Content without writing: points not between digits go first, then all but letters, digits and signs."""
    x = f"translate({folded(nfkc(c))}, '−×÷', '-*/')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{Nd}})\.(\p{{Nd}})', '\1·\2', 'g')"
    x = rf"regexp_replace(replace({x}, '.', ''), '[^\pL\pN+\-*/=^<>%·]', '', 'g')"
    return f"replace({x}, '·', '.')"


#: Rows (record_no, content) of the inventory: JSON objects and labelled fields with their fields in an order of their own.
CONTENT = rf"""
raw_ AS (SELECT record_no, canonical_prompt AS p, ltrim(canonical_prompt) LIKE '{{%' AND json_valid(canonical_prompt) AS is_json FROM inventory WHERE canonical_prompt IS NOT NULL),
marked_ AS (SELECT record_no, is_json, CASE WHEN NOT is_json THEN string_split(regexp_replace(p, '(?i)(^|[|\n\r])([^\pL\pN_|\n\r]*)((?:context|given|find|note)\s*[:：])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) END AS parts,
  CASE WHEN is_json THEN list_transform(json_keys(p), lambda k: k || (p ->> ('$."' || k || '"'))) END AS fields FROM raw_),
pieces_ AS (SELECT record_no, 1 AS n, i, piece FROM (SELECT record_no, unnest(fields) AS piece, generate_subscripts(fields, 1) AS i FROM marked_ WHERE is_json)
  UNION ALL SELECT record_no, CASE WHEN len(parts) > 2 AND i > 1 THEN 1 ELSE 0 END, i, piece FROM (SELECT record_no, parts, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM marked_ WHERE NOT is_json)),
clean_ AS (SELECT record_no, n, i, {squeezed('piece')} AS piece FROM pieces_),
content_ AS (SELECT record_no, string_agg(piece, '' ORDER BY n, CASE WHEN n = 1 THEN '' ELSE lpad(CAST(i AS VARCHAR), 9, '0') END, piece) AS content FROM clean_ GROUP BY record_no)"""

_P2 = f"""
all_ AS (SELECT 'inventory' AS record_set, record_no AS k, content FROM content_ UNION ALL SELECT 'training_rows', line_no, {_hex('canonical_content_hash')} FROM training_rows WHERE {_hex('canonical_content_hash')} IS NOT NULL),
least_ AS (SELECT record_set, k, min(k) OVER (PARTITION BY record_set, content) AS keep, count(*) OVER (PARTITION BY record_set, content) AS copies FROM all_)"""

#: Rows (record_no, content, size, seq): the distinct sequences of three masked words of each prompt.
SEQUENCES = rf"""
masked_ AS (SELECT record_no, {folded(nfkc('canonical_prompt'))} AS t FROM inventory WHERE canonical_prompt IS NOT NULL),
one_ AS (SELECT record_no, regexp_extract_all(t, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*[\pL\pN]*|[\pL\pN]+') AS w FROM masked_),
two_ AS (SELECT record_no, flatten(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*') THEN ['0'] WHEN regexp_matches(x, '[.,]') THEN ['0', regexp_extract(x, '[^.,]*$')] ELSE [x] END)) AS w FROM one_),
seqs_ AS (SELECT DISTINCT record_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS seq FROM (SELECT record_no, w, unnest(range(1, len(w) - 1)) AS i FROM two_)),
sizes_ AS (SELECT record_no, count(*) AS size FROM seqs_ GROUP BY record_no),
common_ AS (SELECT a.record_no AS a, b.record_no AS b, count(*) AS n FROM seqs_ a JOIN seqs_ b ON a.seq = b.seq AND a.record_no < b.record_no GROUP BY ALL),
similar_ AS (SELECT a, b FROM common_ JOIN sizes_ x ON x.record_no = a JOIN sizes_ y ON y.record_no = b WHERE n / (x.size + y.size - n) >= 0.6)"""

_ROWS = f"""
src_ AS (SELECT source_key, max({split_name('source_split')}) AS s FROM source_records WHERE source_key IS NOT NULL GROUP BY source_key),
sided_ AS (SELECT line_no, {_hex('family_id')} AS family, coalesce(s, {split_name("string_split(string_split(r.source_key, '@')[-1], '/')[2]")}) = 'train' AS train FROM training_rows r JOIN src_ USING (source_key)),
row_pairs_ AS (SELECT least(a.line_no, b.line_no) AS a_no, greatest(a.line_no, b.line_no) AS b_no FROM sided_ a JOIN sided_ b ON a.family = b.family AND a.train AND NOT b.train)"""

_INVENTORY_PAIRS = rf"""
split_ AS (SELECT record_no, {split_name('source_split')} = 'train' AS train, trim(source_id) AS source,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(original_id), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '[^\pL\pN]+', '', 'g'), '') AS original FROM inventory),
same_ AS (SELECT a, b FROM similar_ UNION SELECT x.record_no, y.record_no FROM content_ x JOIN content_ y ON x.content = y.content AND x.record_no < y.record_no
  UNION SELECT x.record_no, y.record_no FROM split_ x JOIN split_ y ON x.source = y.source AND x.original = y.original AND x.record_no < y.record_no),
across_ AS (SELECT a, b FROM same_ JOIN split_ x ON x.record_no = a JOIN split_ y ON y.record_no = b WHERE x.train <> y.train)"""

_RUNS = rf"""
dw_ AS (SELECT doc_id, regexp_extract_all({folded(nfkc('text'))}, '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
iw_ AS (SELECT item_id, regexp_extract_all({folded(nfkc('text'))}, '[\pL\pN]+') AS w FROM eval_items WHERE text IS NOT NULL),
dr_ AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw_)),
ir_ AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw_)),
leak_ AS (SELECT DISTINCT doc_id, item_id FROM dr_ JOIN ir_ USING (r))"""

_KEY = r"regexp_replace({c}, '[\s\p{{Z}}_-]+', '-', 'g')"
_NAME = r"lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_MIX = f"""
l_ AS (SELECT *, mix_name || '#' || row_number() OVER (PARTITION BY mix_name ORDER BY name NULLS FIRST, license_class NULLS FIRST, target_share NULLS FIRST, max_repeats NULLS FIRST) AS line
  FROM (SELECT mix_name, {_NAME.format(c='dataset')} AS name, {_KEY.format(c=_NAME.format(c='dataset'))} AS k, license_class, target_share, max_repeats, mix_chars FROM mix_plan)),
s_ AS (SELECT id, {_KEY.format(c=_NAME.format(c='dataset'))} AS k, license_class FROM sources),
i_ AS (SELECT record_no, s_.k, s_.license_class, CAST('0x' || left(md5('mix:' || record_no), 8) AS BIGINT) // 4 AS h, length(canonical_prompt) AS size FROM inventory JOIN s_ ON s_.id = source_id WHERE canonical_prompt IS NOT NULL),
c_ AS (SELECT k, license_class, sum(size) AS supply FROM i_ GROUP BY ALL),
p_ AS (SELECT l_.*, coalesce(supply, 0) AS supply, greatest(coalesce(target_share * mix_chars, 0), 0) AS want, greatest(coalesce(max_repeats, 0), 0) AS most FROM l_ LEFT JOIN c_ ON c_.k = l_.k AND c_.license_class IS NOT DISTINCT FROM l_.license_class),
q_ AS (SELECT *, CASE WHEN supply > 0 THEN least(floor(want / supply), most) ELSE 0 END AS passes FROM p_),
r_ AS (SELECT *, CASE WHEN passes < most THEN want - passes * supply ELSE 0.0 END AS rest FROM q_),
u_ AS (SELECT *, sum(size) OVER (PARTITION BY k, license_class ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM i_),
d_ AS (SELECT line, mix_name, name, r_.license_class, record_no, size, CAST(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS repeats FROM r_ JOIN u_ ON u_.k = r_.k AND u_.license_class IS NOT DISTINCT FROM r_.license_class)"""

ORACLE_SQL = {
    "p2_found": f"WITH {CONTENT}, {_P2} SELECT record_set, keep AS keep_no, k AS copy_no FROM least_ WHERE k > keep",
    "p2_collapsed": f"WITH {CONTENT}, {_P2} SELECT record_set, k AS keep_no, copies FROM least_ WHERE k = keep",
    "p3_found": f"WITH {CONTENT}, {SEQUENCES}, {_INVENTORY_PAIRS}, {_ROWS} SELECT 'inventory' AS record_set, a AS a_no, b AS b_no FROM across_ UNION ALL SELECT 'training_rows', a_no, b_no FROM row_pairs_",
    "p3_overlapping": f"""WITH {CONTENT}, {SEQUENCES}, {_INVENTORY_PAIRS} SELECT DISTINCT r AS record_no FROM (SELECT unnest([a, b]) AS r FROM across_) JOIN split_ ON record_no = r WHERE NOT train""",
    "p3_row_report": rf"""WITH {_ROWS},
        ds_ AS (SELECT source_key, max({_KEY.format(c=_NAME.format(c='dataset'))}) AS source, max({split_name('source_split')}) AS s FROM source_records WHERE source_key IS NOT NULL GROUP BY source_key),
        of_ AS (SELECT source, coalesce(s, {split_name("string_split(string_split(r.source_key, '@')[-1], '/')[2]")}) AS split, {_hex('family_id')} AS family FROM training_rows r JOIN ds_ USING (source_key))
        SELECT source, split, count(*) AS record_count, count(*) FILTER (WHERE family IN (SELECT family FROM of_ WHERE split = 'train' AND family IS NOT NULL)) AS overlapping FROM of_ WHERE split <> 'train' GROUP BY ALL""",
    "p4_mix": f"WITH {_MIX} SELECT mix_name, name AS dataset, license_class, record_no, repeats FROM d_ WHERE repeats > 0",
    "p4_shares": f"""WITH {_MIX}, g_ AS (SELECT line, sum(size * repeats)::BIGINT AS chars FROM d_ GROUP BY line)
        SELECT mix_name, name AS dataset, license_class, target_share, round(CASE WHEN mix_chars > 0 THEN coalesce(chars, 0) / mix_chars END, 6) AS share, coalesce(chars, 0) AS chars, coalesce(target_share * mix_chars > max_repeats * supply, false) AS short FROM p_ LEFT JOIN g_ USING (line)""",
    "p6_found": f"""WITH {CONTENT}, {SEQUENCES} SELECT a AS a_no, b AS b_no FROM similar_ JOIN content_ x ON x.record_no = a JOIN content_ y ON y.record_no = b WHERE x.content <> y.content""",
    "p6_groups": f"""WITH RECURSIVE {CONTENT}, {SEQUENCES},
        set_ AS (SELECT record_no, coalesce(md5(string_agg(seq, '|' ORDER BY seq)), 'none ' || max(content)) AS same, count(seq) AS size FROM content_ LEFT JOIN seqs_ USING (record_no) GROUP BY record_no),
        rep_ AS (SELECT record_no, size, min(record_no) OVER (PARTITION BY same) AS rep FROM set_),
        link_ AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM similar_ s JOIN rep_ x ON x.record_no = s.a JOIN rep_ y ON y.record_no = s.b WHERE x.rep <> y.rep),
        both_ AS (SELECT a, b FROM link_ UNION SELECT b, a FROM link_),
        reach_(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach_ r JOIN both_ e ON r.b = e.a),
        grp_ AS (SELECT a, least(a, min(b)) AS g FROM reach_ GROUP BY a), deg_ AS (SELECT a, count(*) AS links FROM both_ GROUP BY a)
        SELECT record_no, coalesce(g, rep) AS group_no, coalesce(links, 0) AS links FROM rep_ LEFT JOIN grp_ ON grp_.a = rep LEFT JOIN deg_ ON deg_.a = rep""",
    "p3_classes": f"""WITH {CONTENT}, {SEQUENCES}, {_INVENTORY_PAIRS.split("same_ AS")[0].rstrip().rstrip(",")},
        set_ AS (SELECT record_no, train, coalesce(md5(string_agg(seq, '|' ORDER BY seq)), 'none ' || max(content)) AS same, count(seq) AS size FROM content_ JOIN split_ USING (record_no) LEFT JOIN seqs_ USING (record_no) WHERE train IS NOT NULL GROUP BY record_no, train),
        cls_ AS (SELECT record_no, train, min(record_no) OVER (PARTITION BY same) AS c FROM set_),
        sides_ AS (SELECT c, bool_or(train) AS t, bool_or(NOT train) AS e FROM cls_ GROUP BY c),
        near_ AS (SELECT DISTINCT x.c AS a, y.c AS b FROM similar_ s JOIN cls_ x ON x.record_no = s.a JOIN cls_ y ON y.record_no = s.b),
        ends_ AS (SELECT a, b FROM near_ WHERE a <> b UNION SELECT b, a FROM near_ WHERE a <> b UNION SELECT c, c FROM sides_ WHERE t AND e)
        SELECT record_no, cls_.c AS class_no, (SELECT count(*) FROM ends_ JOIN sides_ ON sides_.c = ends_.b WHERE ends_.a = cls_.c AND CASE WHEN cls_.train THEN e ELSE t END) AS links FROM cls_""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_coverage": "SELECT doc_id, coalesce(length(text), 0) AS covered, 0 AS gaps, true AS aligned FROM documents",
    "p1_checks": rf"""
        WITH RECURSIVE rows_ AS (SELECT DISTINCT {_hex('row_id')} AS row_id, {_hex('family_id')} AS family, {_hex('duplicate_of')} AS dup FROM training_rows),
        edge AS (SELECT DISTINCT a.family AS a, b.family AS b FROM rows_ a JOIN rows_ b ON a.dup = b.row_id WHERE a.family <> b.family),
        both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
        reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
        comp AS (SELECT a AS family, min(b) AS c FROM (SELECT family AS a, family AS b FROM rows_ WHERE family IS NOT NULL AND row_id IS NOT NULL UNION SELECT a, b FROM reach) GROUP BY a),
        state AS (SELECT m.build_name, c, bool_or(lower(trim(m.membership)) = 'evaluation') AS e, bool_or(lower(trim(m.membership)) <> 'evaluation') AS o FROM build_membership m JOIN rows_ r ON r.row_id = {_hex('m.row_id')} JOIN comp USING (family) GROUP BY ALL),
        b AS (SELECT DISTINCT build_name FROM split_plan)
        SELECT build_name, (SELECT count(*) FROM comp) AS families, (SELECT count(*) FROM comp JOIN state USING (c) WHERE state.build_name = b.build_name AND e AND o) AS quarantined,
          (SELECT count(*) FROM comp JOIN state USING (c) WHERE state.build_name = b.build_name AND e AND NOT o) AS evaluated, (SELECT count(*) FROM comp JOIN state USING (c) WHERE state.build_name = b.build_name AND o AND NOT e) AS kept_in_train, 0 AS torn_components FROM b""",
    "p8_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM leak_",
    "p8_items": f"WITH {_RUNS} SELECT item_id, suite, count(*) AS documents FROM leak_ JOIN eval_items USING (item_id) GROUP BY ALL",
    # the least total lack of minimums in a subject: by Hall's theorem the largest, over sets of its cells, of what
    # they ask for in excess of the records that any of them can have
    "p5_shortfalls": rf"""
        WITH m_ AS (SELECT subject, behavior, max(minimum_examples) AS minimum FROM balanced_tutoring_v8 GROUP BY ALL),
        p_ AS (SELECT DISTINCT sample_name, p.subject, p.behavior, coalesce(minimum, 0) AS minimum FROM sample_plan p LEFT JOIN m_ USING (subject, behavior)),
        s_ AS (SELECT record_no, {_SUBJECT.format(s=_SPELLED)} AS subject, list_distinct(eligible_behaviors) AS own FROM inventory WHERE subject IS NOT NULL),
        b_ AS (SELECT sample_name, subject, list(behavior ORDER BY behavior) AS bs, list(minimum ORDER BY behavior) AS ms FROM p_ GROUP BY ALL),
        t_ AS (SELECT sample_name, subject, list_filter(bs, lambda x, i: (k >> (i - 1)) & 1 = 1) AS chosen, list_sum(list_filter(ms, lambda x, i: (k >> (i - 1)) & 1 = 1)) AS asked FROM b_, range(1, 16) r(k) WHERE k < (1 << len(bs))),
        n_ AS (SELECT sample_name, t_.subject, asked, (SELECT count(*) FROM s_ WHERE s_.subject = t_.subject AND list_has_any(s_.own, t_.chosen)) AS n FROM t_)
        SELECT sample_name, subject, greatest(0, max(asked - n))::BIGINT AS lack, 0::BIGINT AS twice, 0::BIGINT AS foreign_records FROM n_ GROUP BY ALL""",
}
