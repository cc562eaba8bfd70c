"""DuckDB SQL of the record-linkage queries."""

from __future__ import annotations

_CLEAN = r"trim(regexp_replace(replace(regexp_replace(strip_accents(lower({})), '<null>|\bnull\b|\bn/a\b', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"

_CANDS = """cands AS (
    SELECT s1_idx, pool_idx, bscore, n_keys, round(bscore / (bscore + 20.0), 6) AS p FROM (
        SELECT s1_idx, pool_idx, MAX(bscore) AS bscore, MAX(n_keys) AS n_keys FROM candidates
        WHERE bscore IS NOT NULL AND NOT isnan(bscore) GROUP BY s1_idx, pool_idx))"""

_POOL = """links AS (
    SELECT DISTINCT source1_entity_id AS sid, trim(x) AS eid
    FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS x FROM train_matches) WHERE trim(x) <> ''),
gids AS (SELECT l.eid, MIN(s.idx) AS g FROM links l JOIN train_s1 s ON s.eid = l.sid GROUP BY l.eid),
pool AS (SELECT p.*, COALESCE(g.g, -1) AS gid FROM train_pool p LEFT JOIN gids g ON g.eid = p.eid)"""

_EXCLUSIVE = """best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool_idx ORDER BY p DESC, s1_idx) AS r FROM cands) WHERE r = 1)"""


def _keys(source: str) -> str:
    return f"""
    name_tokens AS (SELECT idx, country_norm, list_sort(list_distinct(name_tok)) AS n, addr_tok AS a FROM {source}),
    n1 AS (SELECT idx, country_norm, unnest(n) AS k FROM name_tokens),
    a1 AS (SELECT idx, country_norm, unnest(list_distinct(a)) AS k FROM name_tokens),
    ab AS (SELECT DISTINCT idx, country_norm, a[i] || ' ' || a[i + 1] AS k FROM (SELECT idx, country_norm, a, unnest(range(1, len(a))) AS i FROM name_tokens)),
    keys AS (
        SELECT idx, country_norm, 'n1' AS t, k AS key FROM n1
        UNION ALL SELECT idx, country_norm, 'a1', k FROM a1
        UNION ALL SELECT x.idx, x.country_norm, 'nn', x.k || ' ' || y.k FROM n1 x JOIN n1 y ON x.idx = y.idx AND x.k < y.k
        UNION ALL SELECT idx, country_norm, 'ab', k FROM ab)"""


def _renamed(prefix: str, source: str) -> str:
    """The key CTEs of ``source`` under names that begin with ``prefix``."""
    out = _keys(source)
    for name in ("name_tokens", "n1", "a1", "ab", "keys"):
        out = out.replace(f" {name} AS (", f" {prefix}_{name} AS (").replace(f"FROM {name}", f"FROM {prefix}_{name}").replace(f"JOIN {name}", f"JOIN {prefix}_{name}")
    return out


_IDF = """{p}_df AS (SELECT country_norm, t, key, COUNT(*) AS df FROM {p}_keys GROUP BY ALL HAVING COUNT(*) <= 50),
    {p}_n AS (SELECT country_norm, COUNT(*) AS n FROM train_pool GROUP BY country_norm),
    {p}_idf AS (SELECT d.country_norm, d.t, d.key, d.df, ln(GREATEST(n.n, 2)) - ln(d.df) AS idf FROM {p}_df d JOIN {p}_n n ON n.country_norm = d.country_norm)""".format(p="p")

_CONTEXT = """SELECT s1_idx, pool_idx, round(bscore, 6) AS bscore,
    CAST(ROW_NUMBER() OVER (PARTITION BY s1_idx ORDER BY bscore DESC, pool_idx) AS DOUBLE) AS b_rank_s1,
    round(bscore - MAX(bscore) OVER (PARTITION BY s1_idx), 6) AS b_gap_s1max,
    CAST(ROW_NUMBER() OVER (PARTITION BY pool_idx ORDER BY bscore DESC, s1_idx) AS DOUBLE) AS b_rank_pool,
    round(bscore - MAX(bscore) OVER (PARTITION BY pool_idx), 6) AS b_gap_poolmax,
    CAST(COUNT(*) OVER (PARTITION BY pool_idx) AS DOUBLE) AS b_n_s1_for_pool FROM {}"""

_PER_ENTITY = """truth AS (SELECT gid AS s1_idx, COUNT(*) AS n_true FROM pool WHERE gid >= 0 GROUP BY gid),
got AS (SELECT d.s1_idx, COUNT(*) AS n_pred, SUM(CASE WHEN q.gid = d.s1_idx THEN 1 ELSE 0 END) AS tp FROM {pred} d LEFT JOIN pool q ON q.idx = d.pool_idx GROUP BY d.s1_idx),
per AS (SELECT s.idx AS s1_idx, COALESCE(n_true, 0) AS n_true, COALESCE(n_pred, 0) AS n_pred, COALESCE(tp, 0) AS tp
        FROM train_s1 s LEFT JOIN truth t ON t.s1_idx = s.idx LEFT JOIN got g ON g.s1_idx = s.idx)"""

_F = """CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0
    ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"""


def _bucket(key: str, salt: int, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n})"


def _jaccard(c: str, a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"round({common} / GREATEST({union}, 1), 6) AS jac_{c}, CAST({common} AS DOUBLE) AS ncommon_{c}"


_NUMBERS = "list_filter({}, lambda x: regexp_full_match(x, '[0-9]+'))"
_EXCEPT = "list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_GRID = ", ".join(f"{round(0.05 * i, 2):.2f}" for i in range(4, 20))

SQL = {
    "candidates_topk": f"""
        WITH {_renamed("p", "train_pool")}, {_IDF},
        posting AS (SELECT k.country_norm, k.t, k.key, k.idx AS pool_idx, i.idf FROM p_keys k JOIN p_idf i ON i.country_norm = k.country_norm AND i.t = k.t AND i.key = k.key),
        {_renamed("s", "train_s1")},
        pairs AS (SELECT s.idx AS s1_idx, p.pool_idx, SUM(p.idf) AS bscore, COUNT(*) AS n_keys
                  FROM s_keys s JOIN posting p ON p.country_norm = s.country_norm AND p.t = s.t AND p.key = s.key GROUP BY s.idx, p.pool_idx)
        SELECT s1_idx, pool_idx, round(bscore, 6) AS bscore, n_keys
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY s1_idx ORDER BY round(bscore, 9) DESC, pool_idx) AS r FROM pairs) WHERE r <= 20""",
    "source_records": """
        SELECT DISTINCT entity_id AS eid, COALESCE(business_name, '') AS name, COALESCE(business_address, '') AS addr, COALESCE(country, '') AS country, CAST(2 AS TINYINT) AS src FROM train_source2
        UNION SELECT DISTINCT entity_id, COALESCE(business_name, ''), COALESCE(business_address, ''), COALESCE(country, ''), CAST(3 AS TINYINT) FROM train_source3""",
    "clean_text": f"SELECT sample_id AS id, {_CLEAN.format('text')} AS cleaned FROM lang_samples UNION ALL SELECT item_id, {_CLEAN.format('text')} FROM eval_items",
    "tokenize": f"""
        SELECT sample_id, CAST(i - 1 AS INTEGER) AS place, w[i] AS token
        FROM (SELECT sample_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT sample_id, string_split({_CLEAN.format('text')}, ' ') AS w FROM lang_samples))""",
    "normalize_s1": "SELECT idx, name_norm, addr_norm, country_norm, name_deva FROM train_s1",
    "normalize_pool": "SELECT idx, name_norm, addr_norm, country_norm, name_deva FROM train_pool",
    "abbrev_expand": "SELECT token, COUNT(*) AS n FROM (SELECT unnest(addr_tok) AS token FROM train_pool) GROUP BY token",
    "name_deva_flag": "SELECT src, CAST(SUM(CASE WHEN name_deva THEN 1 ELSE 0 END) AS BIGINT) AS n_indic, COUNT(*) AS n FROM train_pool GROUP BY src",
    "numeric_tokens": f"SELECT idx, array_to_string({_NUMBERS.format('addr_tok')}, ' ') AS numbers FROM train_pool",
    "block_keys": f"WITH {_keys('train_s1')} SELECT idx, t, key FROM keys",
    "key_df_idf": f"WITH {_renamed('p', 'train_pool')}, {_IDF} SELECT country_norm, t, key, df, round(idf, 6) AS idf FROM p_idf",
    "candidate_context": f"WITH {_CANDS} {_CONTEXT.format('cands')}",
    "token_jaccard": f"""
        WITH {_CANDS},
        a AS (SELECT *, {_NUMBERS.format('addr_tok')} AS num FROM train_s1), b AS (SELECT *, {_NUMBERS.format('addr_tok')} AS num FROM train_pool)
        SELECT c.s1_idx, c.pool_idx, {_jaccard('name_tok', 'a.name_tok', 'b.name_tok')}, {_jaccard('addr_tok', 'a.addr_tok', 'b.addr_tok')}, {_jaccard('addr_num', 'a.num', 'b.num')},
               CAST(a.name_tok[1] = b.name_tok[1] AS DOUBLE) AS first_tok_eq,
               CAST(length(a.name_norm) AS DOUBLE) AS len_name_a, CAST(length(b.name_norm) AS DOUBLE) AS len_name_b,
               CAST(length(a.addr_norm) AS DOUBLE) AS len_addr_a, CAST(length(b.addr_norm) AS DOUBLE) AS len_addr_b,
               CAST(len(a.num) AS DOUBLE) AS nnum_a, CAST(len(b.num) AS DOUBLE) AS nnum_b,
               CAST(len({_EXCEPT.format(a='a.num', b='b.num')}) = 0 AS DOUBLE) AS num_a_subset_b,
               CAST(b.name_deva AS DOUBLE) AS deva_b, CAST(b.src AS DOUBLE) AS src_b
        FROM cands c JOIN a ON a.idx = c.s1_idx JOIN b ON b.idx = c.pool_idx""",
    "name_ambiguity": """
        WITH a AS (SELECT country_norm, name_norm, COUNT(*) AS n FROM train_s1 GROUP BY ALL), b AS (SELECT country_norm, name_norm, COUNT(*) AS n FROM train_pool GROUP BY ALL)
        SELECT s.idx, CAST(COALESCE(a.n, 0) AS DOUBLE) AS n_s1_same_name, CAST(COALESCE(b.n, 0) AS DOUBLE) AS n_pool_same_name
        FROM train_s1 s LEFT JOIN a ON a.country_norm = s.country_norm AND a.name_norm = s.name_norm LEFT JOIN b ON b.country_norm = s.country_norm AND b.name_norm = s.name_norm""",
    "token_idf": """
        WITH both_sides AS (SELECT country_norm, name_tok FROM train_s1 UNION ALL SELECT country_norm, name_tok FROM train_pool),
        n AS (SELECT country_norm, COUNT(*) AS n FROM both_sides GROUP BY country_norm),
        d AS (SELECT country_norm, tok, COUNT(*) AS df FROM (SELECT country_norm, unnest(list_distinct(name_tok)) AS tok FROM both_sides) GROUP BY ALL)
        SELECT d.country_norm, tok, round(ln((n.n + 1) / (df + 1)), 6) AS idf FROM d JOIN n ON n.country_norm = d.country_norm""",
    "name_evidence": f"""
        WITH {_CANDS},
        both_sides AS (SELECT country_norm, name_tok FROM train_s1 UNION ALL SELECT country_norm, name_tok FROM train_pool),
        n AS (SELECT country_norm, COUNT(*) AS n FROM both_sides GROUP BY country_norm),
        d AS (SELECT country_norm, tok, COUNT(*) AS df FROM (SELECT country_norm, unnest(list_distinct(name_tok)) AS tok FROM both_sides) GROUP BY ALL),
        idf AS (SELECT d.country_norm, tok, ln((n.n + 1) / (df + 1)) AS w FROM d JOIN n ON n.country_norm = d.country_norm),
        c1 AS (SELECT country_norm, name_norm, COUNT(*) AS n FROM train_s1 GROUP BY ALL), c2 AS (SELECT country_norm, name_norm, COUNT(*) AS n FROM train_pool GROUP BY ALL),
        x AS (SELECT c.s1_idx, c.pool_idx, a.country_norm AS ca, b.country_norm AS cb, a.name_norm AS na, b.name_norm AS nb, a.name_tok AS ta, b.name_tok AS tb
              FROM cands c JOIN train_s1 a ON a.idx = c.s1_idx JOIN train_pool b ON b.idx = c.pool_idx),
        parts AS (
            SELECT s1_idx, pool_idx, ca AS land, 'sh' AS part, unnest(list_intersect(ta, tb)) AS tok FROM x
            UNION ALL SELECT s1_idx, pool_idx, ca, 'ao', unnest({_EXCEPT.format(a='ta', b='tb')}) FROM x
            UNION ALL SELECT s1_idx, pool_idx, ca, 'bo', unnest({_EXCEPT.format(a='tb', b='ta')}) FROM x),
        sums AS (SELECT s1_idx, pool_idx, part, SUM(COALESCE(w, ln(1000000))) AS s, MAX(COALESCE(w, ln(1000000))) AS m
                 FROM parts LEFT JOIN idf ON idf.country_norm = land AND idf.tok = parts.tok GROUP BY ALL),
        wide AS (SELECT s1_idx, pool_idx,
                 COALESCE(MAX(s) FILTER (part = 'sh'), 0) AS ss, COALESCE(MAX(m) FILTER (part = 'sh'), 0) AS sm, COALESCE(MAX(s) FILTER (part = 'ao'), 0) AS s1, COALESCE(MAX(m) FILTER (part = 'ao'), 0) AS m1,
                 COALESCE(MAX(s) FILTER (part = 'bo'), 0) AS s2, COALESCE(MAX(m) FILTER (part = 'bo'), 0) AS m2 FROM sums GROUP BY ALL)
        SELECT x.s1_idx, x.pool_idx, round(COALESCE(ss, 0), 6) AS shared_idf_sum, round(COALESCE(sm, 0), 6) AS shared_idf_max, round(COALESCE(s1, 0), 6) AS s1only_idf_sum, round(COALESCE(m1, 0), 6) AS s1only_idf_max,
               round(COALESCE(s2, 0), 6) AS poolonly_idf_sum, round(COALESCE(m2, 0), 6) AS poolonly_idf_max,
               round(COALESCE(ss, 0) / GREATEST(COALESCE(ss + s1 + s2, 0), 1e-6), 6) AS idf_jacc,
               CAST(COALESCE(a1.n, 0) AS DOUBLE) AS n_s1_same_name_a, CAST(COALESCE(a2.n, 0) AS DOUBLE) AS n_pool_same_name_a, CAST(COALESCE(b1.n, 0) AS DOUBLE) AS n_s1_same_name_b, CAST(COALESCE(b2.n, 0) AS DOUBLE) AS n_pool_same_name_b
        FROM x LEFT JOIN wide w ON w.s1_idx = x.s1_idx AND w.pool_idx = x.pool_idx
        LEFT JOIN c1 a1 ON a1.country_norm = ca AND a1.name_norm = na LEFT JOIN c2 a2 ON a2.country_norm = ca AND a2.name_norm = na
        LEFT JOIN c1 b1 ON b1.country_norm = cb AND b1.name_norm = nb LEFT JOIN c2 b2 ON b2.country_norm = cb AND b2.name_norm = nb""",
    "stage2_context": f"""
        WITH {_CANDS}, r AS (SELECT s1_idx, pool_idx, p, ROW_NUMBER() OVER (PARTITION BY pool_idx ORDER BY p DESC, s1_idx) AS rp FROM cands),
        tops AS (SELECT pool_idx, MAX(CASE WHEN rp = 1 THEN p END) AS a, MAX(CASE WHEN rp = 2 THEN p END) AS b FROM r GROUP BY pool_idx)
        SELECT r.s1_idx, r.pool_idx, round(p, 6) AS p,
            CAST(ROW_NUMBER() OVER (PARTITION BY s1_idx ORDER BY p DESC, r.pool_idx) AS DOUBLE) AS p_rank_s1,
            round(MAX(p) OVER (PARTITION BY s1_idx) - p, 6) AS p_gap_s1max, round(SUM(p) OVER (PARTITION BY s1_idx), 6) AS p_sum_s1,
            CAST(COUNT(*) FILTER (p > 0.5) OVER (PARTITION BY s1_idx) AS DOUBLE) AS p_n05_s1,
            CAST(rp AS DOUBLE) AS p_rank_pool, round(MAX(p) OVER (PARTITION BY r.pool_idx) - p, 6) AS p_gap_poolmax, round(SUM(p) OVER (PARTITION BY r.pool_idx), 6) AS p_sum_pool,
            CAST(COUNT(*) FILTER (p > 0.5) OVER (PARTITION BY r.pool_idx) AS DOUBLE) AS p_n05_pool,
            round(COALESCE(CASE WHEN p >= a THEN b ELSE a END, 0), 6) AS p_best_other_s1
        FROM r JOIN tops t ON t.pool_idx = r.pool_idx""",
    "decide_threshold": f"WITH {_CANDS} SELECT s1_idx, pool_idx FROM cands WHERE p >= 0.6",
    "decide_exclusive": f"WITH {_CANDS}, {_EXCLUSIVE} SELECT s1_idx, pool_idx FROM best WHERE p >= 0.6",
    "expected_f": f"""
        WITH {_CANDS}, {_EXCLUSIVE},
        e AS (SELECT s1_idx, exp(SUM(ln(GREATEST(LEAST(1 - p, 1.0), 1e-9)))) AS e0 FROM best GROUP BY s1_idx),
        k AS (SELECT s1_idx, pool_idx, ROW_NUMBER() OVER w AS k, SUM(p) OVER (PARTITION BY s1_idx ORDER BY p DESC, pool_idx ROWS UNBOUNDED PRECEDING) AS tp, SUM(p) OVER (PARTITION BY s1_idx) AS n
              FROM best WHERE p >= 0.05 WINDOW w AS (PARTITION BY s1_idx ORDER BY p DESC, pool_idx)),
        f AS (SELECT *, round(1.25 * tp / (k + 0.25 * n), 12) AS ef FROM k),
        b AS (SELECT s1_idx, MAX(ef) AS most FROM f GROUP BY s1_idx),
        kb AS (SELECT f.s1_idx, MIN(k) AS kbest, MAX(most) AS most FROM f JOIN b ON b.s1_idx = f.s1_idx AND f.ef = b.most GROUP BY f.s1_idx)
        SELECT f.s1_idx, f.pool_idx FROM f JOIN kb ON kb.s1_idx = f.s1_idx JOIN e ON e.s1_idx = f.s1_idx WHERE most > e0 AND k <= kbest""",
    "macro_f05": f"""
        WITH {_CANDS}, {_POOL}, {_EXCLUSIVE}, pred AS (SELECT s1_idx, pool_idx FROM best WHERE p >= 0.6), {_PER_ENTITY.format(pred='pred')},
        f AS (SELECT *, {_F} AS f FROM per)
        SELECT round(AVG(f), 6) AS f05, round(AVG(CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS precision_macro,
               round(AVG(CASE WHEN n_true > 0 THEN tp / n_true WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_macro,
               round(AVG(f) FILTER (n_true = 0), 6) AS singleton_acc, round(AVG(f) FILTER (n_true > 0), 6) AS nonsingleton_f05,
               round(SUM(tp) / GREATEST(SUM(n_pred), 1), 6) AS pair_precision, round(SUM(tp) / GREATEST(SUM(n_true), 1), 6) AS pair_recall, COUNT(*) AS n_entities FROM f""",
    "blocking_report": f"""
        WITH {_CANDS}, {_POOL}, {_PER_ENTITY.format(pred='cands')}
        SELECT round(SUM(tp) / GREATEST(SUM(n_true), 1), 6) AS pair_recall, CAST(SUM(n_true) AS BIGINT) AS true_pairs, CAST(SUM(n_pred) AS BIGINT) AS cand_pairs,
               round(AVG(n_pred) FILTER (n_pred > 0), 6) AS mean_cands, round(MEDIAN(n_pred) FILTER (n_pred > 0), 6) AS median_cands, MAX(n_pred) AS max_cands, COUNT(*) FILTER (n_pred = 0) AS s1_zero_cands,
               round(AVG(CASE WHEN n_true = 0 THEN 1.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS f05_ceiling FROM per""",
    "recall_at_k": f"""
        WITH {_CANDS}, {_POOL}, r AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY s1_idx ORDER BY bscore DESC, pool_idx) AS r FROM cands c),
        hits AS (SELECT r FROM r JOIN pool q ON q.idx = r.pool_idx WHERE q.gid = r.s1_idx), total AS (SELECT COUNT(*) AS n FROM pool WHERE gid >= 0)
        SELECT k, round((SELECT COUNT(*) FROM hits WHERE r <= k) / GREATEST((SELECT n FROM total), 1), 6) AS recall FROM (SELECT CAST(unnest([5, 10, 20, 50, 100]) AS INTEGER) AS k)""",
    "threshold_sweep": f"""
        WITH {_CANDS}, {_POOL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool_idx ORDER BY p DESC, s1_idx) AS r FROM cands),
        rules AS (SELECT CAST(thr AS DOUBLE) AS thr, only_best FROM (SELECT unnest([{_GRID}]) AS thr), (SELECT unnest([TRUE, FALSE]) AS only_best)),
        got AS (SELECT thr, only_best, r.s1_idx, COUNT(*) AS n_pred, SUM(CASE WHEN q.gid = r.s1_idx THEN 1 ELSE 0 END) AS tp
                FROM r JOIN rules ON r.p >= thr AND (NOT only_best OR r.r = 1) LEFT JOIN pool q ON q.idx = r.pool_idx GROUP BY ALL),
        truth AS (SELECT gid AS s1_idx, COUNT(*) AS n_true FROM pool WHERE gid >= 0 GROUP BY gid),
        per AS (SELECT rules.thr, rules.only_best, COALESCE(n_true, 0) AS n_true, COALESCE(n_pred, 0) AS n_pred, COALESCE(tp, 0) AS tp
                FROM train_s1 s CROSS JOIN rules LEFT JOIN truth t ON t.s1_idx = s.idx LEFT JOIN got g ON g.s1_idx = s.idx AND g.thr = rules.thr AND g.only_best = rules.only_best)
        SELECT thr, only_best, round(AVG({_F}), 6) AS f05, round(SUM(tp) / GREATEST(SUM(n_pred), 1), 6) AS pair_precision, round(SUM(tp) / GREATEST(SUM(n_true), 1), 6) AS pair_recall FROM per GROUP BY thr, only_best""",
    "label_join": f"WITH {_POOL} SELECT idx, eid, gid FROM pool",
    "semi_truth": f"WITH {_CANDS}, {_POOL} SELECT idx, gid FROM pool WHERE gid IN (SELECT s1_idx FROM cands)",
    "hash_fold": f"SELECT idx, {_bucket('eid', 42, 2)} AS fold, {_bucket('eid', 5, 1000)} AS bucket FROM train_s1",
    "absent_entities": f"WITH {_CANDS}, kept AS (SELECT * FROM cands WHERE {_bucket('s1_idx', 5, 1000)} < 810 AND s1_idx IN (SELECT idx FROM train_s1)) {_CONTEXT.format('kept')}",
    "translit_learn": f"""
        WITH {_POOL},
        pr AS (SELECT q.idx AS pair, q.name_tok AS pn, q.addr_tok AS pa, s.name_tok AS sn, s.addr_tok AS sa FROM pool q JOIN train_s1 s ON s.idx = q.gid WHERE q.gid >= 0),
        al AS (SELECT unnest(pn) AS d, unnest(sn) AS l FROM pr WHERE len(pn) = len(sn)),
        nc AS (SELECT d, l, COUNT(*) AS n FROM al WHERE regexp_matches(d, '[\\x{{0900}}-\\x{{0dff}}]') GROUP BY ALL),
        nb AS (SELECT d, l FROM (SELECT d, l, n, ROW_NUMBER() OVER (PARTITION BY d ORDER BY n DESC, l) AS r, SUM(n) OVER (PARTITION BY d) AS total FROM nc) WHERE r = 1 AND total >= 3 AND n >= 0.5 * total),
        ad AS (SELECT pair, list_distinct(pa) AS pa, list_distinct(sa) AS sa FROM pr WHERE len(list_filter(pa, lambda t: regexp_matches(t, '[\\x{{0900}}-\\x{{0dff}}]'))) > 0),
        la AS (SELECT l, COUNT(*) AS nl FROM (SELECT unnest(sa) AS l FROM ad) GROUP BY l),
        ce AS (SELECT * FROM (SELECT pair, sa, unnest(pa) AS d FROM ad) WHERE regexp_matches(d, '[\\x{{0900}}-\\x{{0dff}}]')),
        nd AS (SELECT d, COUNT(*) AS nd FROM ce GROUP BY d HAVING COUNT(*) >= 3),
        bo AS (SELECT d, l, COUNT(*) AS n FROM (SELECT d, unnest(sa) AS l FROM ce) GROUP BY ALL),
        li AS (SELECT bo.d, bo.l, (n / nd.nd) * (SELECT COUNT(*) FROM ad) / la.nl AS lift FROM bo JOIN nd ON nd.d = bo.d JOIN la ON la.l = bo.l WHERE n / nd.nd >= 0.8),
        ab AS (SELECT d, l FROM (SELECT d, l, ROW_NUMBER() OVER (PARTITION BY d ORDER BY lift DESC, l) AS r FROM li) WHERE r = 1)
        SELECT d AS src_tok, l AS dst_tok FROM nb UNION ALL SELECT d, l FROM ab WHERE d NOT IN (SELECT d FROM nb)""",
    "id_lists": f"""
        WITH {_CANDS}, {_EXCLUSIVE}, g AS (SELECT b.s1_idx, string_agg(q.eid, ',' ORDER BY q.eid) AS ids FROM best b JOIN train_pool q ON q.idx = b.pool_idx WHERE b.p >= 0.6 GROUP BY b.s1_idx)
        SELECT s.eid AS source1_entity_id, COALESCE(ids, '') AS matched_entity_ids FROM train_s1 s LEFT JOIN g ON g.s1_idx = s.idx""",
}

# The same with the reference's caps and number of candidates.
SQL |= {
    "key_df_idf_whole": SQL["key_df_idf"].replace("HAVING COUNT(*) <= 50)", "HAVING COUNT(*) <= 500)"),
    "candidates_whole": SQL["candidates_topk"].replace("HAVING COUNT(*) <= 50)", "HAVING COUNT(*) <= 500)").replace("WHERE r <= 20", "WHERE r <= 300"),
}


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of up to 120 letters, by the bit-parallel recurrence."""
    full = f"((1::HUGEINT << length({a})::INTEGER) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = ch THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END))::HUGEINT"
    last = f"list_reduce(list_transform(string_split({b}, ''), lambda ch: {mask}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE bit_count(xor({full}, {last})) END"


def _ratio(a: str, b: str) -> str:
    return f"200.0 * ({_lcs(a, b)}) / (length({a}) + length({b}))"


def _windows(a: str, b: str) -> str:
    """Best ratio of a against the stretches of b of its length and the shorter ones at both ends; a is the shorter."""
    window = f"substring({b}, greatest(s, 1), least(s + length({a}) - 1, length({b})) - greatest(s, 1) + 1)"
    return f"list_max(list_transform(list_transform(range(2 - length({a}), length({b}) + 1), lambda s: {window}), lambda w: {_ratio(a, 'w')}))"


_NAMES = f"""{_CANDS}, t AS (SELECT c.s1_idx, c.pool_idx, a.name_norm AS a, b.name_norm AS b FROM cands c JOIN train_s1 a ON a.idx = c.s1_idx JOIN train_pool b ON b.idx = c.pool_idx
    WHERE a.name_norm <> '' AND b.name_norm <> '')"""
_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
SQL |= {
    "sim_ratio": f"WITH {_NAMES} SELECT s1_idx, pool_idx, round({_ratio('a', 'b')}, 6) AS score FROM t",
    "sim_token_sort": f"WITH {_NAMES}, u AS (SELECT s1_idx, pool_idx, {_SORTED.format('a')} AS a, {_SORTED.format('b')} AS b FROM t) SELECT s1_idx, pool_idx, round({_ratio('a', 'b')}, 6) AS score FROM u",
    "sim_token_set": f"""
        WITH {_NAMES}, u AS (SELECT s1_idx, pool_idx, list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM t),
        w AS (SELECT s1_idx, pool_idx, array_to_string(list_sort(list_intersect(a, b)), ' ') AS c,
                     array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS x, array_to_string(list_sort(list_filter(b, lambda y: NOT list_contains(a, y))), ' ') AS y FROM u),
        l AS (SELECT *, length(c) AS n, length(x) AS p, length(y) AS q, {_lcs('x', 'y')} AS k FROM w)
        SELECT s1_idx, pool_idx, round(CASE WHEN n = 0 THEN 200.0 * k / (p + q) WHEN p = 0 OR q = 0 THEN 100.0
            ELSE GREATEST(200.0 * (n + 1 + k) / (2 * n + 2 + p + q), 200.0 * n / (2 * n + 1 + p), 200.0 * n / (2 * n + 1 + q)) END, 6) AS score FROM l""",
    "sim_partial": f"""
        WITH {_NAMES}, u AS (SELECT s1_idx, pool_idx, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS a, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS b FROM t)
        SELECT s1_idx, pool_idx, round(CASE WHEN contains(b, a) THEN 100.0 WHEN length(a) = length(b) THEN GREATEST({_windows('a', 'b')}, {_windows('b', 'a')}) ELSE {_windows('a', 'b')} END, 6) AS score FROM u""",
    "leftover_similarity": f"""
        WITH {_CANDS}, t AS (SELECT c.s1_idx, c.pool_idx, a.name_tok AS p, b.name_tok AS q FROM cands c JOIN train_s1 a ON a.idx = c.s1_idx JOIN train_pool b ON b.idx = c.pool_idx),
        u AS (SELECT s1_idx, pool_idx, array_to_string(list_filter(p, lambda x, i: NOT list_contains(q, x) AND list_position(p, x) = i), ' ') AS a,
                     array_to_string(list_filter(q, lambda y, j: NOT list_contains(p, y) AND list_position(q, y) = j), ' ') AS b FROM t)
        SELECT s1_idx, pool_idx, round(CASE WHEN a = '' AND b = '' THEN 100.0 ELSE {_ratio('a', 'b')} END, 6) AS leftover_ratio FROM u""",
}
