"""DuckDB oracle SQL for the registered workloads.

Written independently of the Spark code: regexes use RE2 with explicit
Unicode boundary classes instead of ``\\b``/look-ahead, LCS is a bit-parallel
recursive CTE over HUGEINT, TF-IDF is refitted literally.  Tables
``part documents benchmark labels events`` are the driver's views.
"""
from __future__ import annotations

from .config import CATEGORY_SYSTEM_PROMPT, DEFAULT_SEEDS
from .workloads import FIXTURE_NAMES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
L_B = f"(^|{NW})"
R_B = f"($|{NW})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def hint(n: str) -> str:
    r1 = rf"(non.?alcohol|alcohol.?free|0%\s*abv|sunbrew)"
    r2 = (r"(hard\s+seltzer|hard\s+selt|hard\s+lem|hard\s+tea|hard\s+cider|hard\s+kombucha|"
          r"hard\s+ginger|malt\s+bev|rtd|ready.to.drink|spiked)")
    r3 = r"(lager|ale|ipa|stout|porter|pilsner|pilsener|bock|saison|cerveza|beer|weiss|weizen|hefe)"
    r4 = (r"(wine|chardonnay|merlot|cabernet|sauvignon|pinot|riesling|ros[eé]|prosecco|champagne|"
          r"sparkling\s+wine|shiraz|malbec|zinfandel)")
    r5 = (r"(vodka|whisky|whiskey|bourbon|scotch|rum|tequila|gin|brandy|cognac|liqueur|mezcal|"
          r"absinthe|schnapps|triple\s+sec|vermouth)")
    r6 = (r"(water|juice|soda|cola|coffee|tea|energy\s+drink|sports\s+drink|lemonade|kombucha|"
          r"smoothie|shake|protein|vitamin)")
    m3 = rf"regexp_replace({n}, '(?i)cider(\s+vin)', '#####\1', 'g')"
    m6 = (rf"regexp_replace(regexp_replace({n}, '(?i)tea(\s+hard)', '###\1', 'g'), "
          rf"'(?i)kombucha(\s+hard)', '########\1', 'g')")
    return (
        "CASE "
        f"WHEN regexp_matches({n}, '(?i){L_B}{r1}{R_B}') OR regexp_matches({n}, '(?i){L_B}0\\.0%{W}') "
        "THEN 'Non-alcoholic Beer' "
        f"WHEN regexp_matches({n}, '(?i){L_B}{r2}{R_B}') THEN 'Hard Beverage' "
        f"WHEN regexp_matches({n}, '(?i){L_B}{r3}{R_B}') OR regexp_matches({m3}, '(?i){L_B}cider{R_B}') "
        "THEN 'Beer' "
        f"WHEN regexp_matches({n}, '(?i){L_B}{r4}{R_B}') THEN 'Wine' "
        f"WHEN regexp_matches({n}, '(?i){L_B}{r5}{R_B}') THEN 'Spirits' "
        f"WHEN regexp_matches({m6}, '(?i){L_B}{r6}{R_B}') THEN 'Non-alcoholic Beverage' "
        "END")


_NOISE = (r"(\d+\s*(x|pk|pack|ml|cl|l|oz|fl\.?\s*oz|can|cans|bottle|bottles|longneck|tallboy|"
          r"stubby|keg|case|litre|liter|pint|quart)|premium|select|special|reserve|vintage|limited|"
          r"edition|fresh|natural|organic|imported|import|domestic|draft|draught)")


def clean(n: str) -> str:
    """Noise removal; two passes because a consumed boundary character hides
    an adjacent match in the first pass."""
    p1 = rf"regexp_replace({n}, '(?i){L_B}{_NOISE}{R_B}', '\1 \4', 'g')"
    p2 = rf"regexp_replace({p1}, '(?i){L_B}{_NOISE}{R_B}', '\1 \4', 'g')"
    c = strip(rf"regexp_replace({p2}, '\s{{2,}}', ' ', 'g')")
    return f"(CASE WHEN {c} = '' THEN {n} ELSE {c} END)"


def strip_generic(n: str) -> str:
    pat = rf"(?i){L_B}(beer|ale|brew|brewing|brewed){R_B}"
    p1 = rf"regexp_replace({n}, '{pat}', '\1\3', 'g')"
    p2 = rf"regexp_replace({p1}, '{pat}', '\1\3', 'g')"
    c = strip(p2)
    return f"(CASE WHEN {c} = '' THEN {n} ELSE {c} END)"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def sort_tokens(x: str) -> str:
    return f"array_to_string(list_sort({tokens(x)}), ' ')"


def pri_save(c: str = "source") -> str:
    return (f"CASE {c} WHEN 'human' THEN 0 WHEN 'seed' THEN 1 WHEN 'llm' THEN 2 WHEN 'batch_cache' THEN 3 "
            f"WHEN 'vector' THEN 4 WHEN 'fuzzy' THEN 5 WHEN 'ml' THEN 6 WHEN 'keyword' THEN 7 ELSE 8 END")


def pri_train(c: str = "source") -> str:
    return f"CASE {c} WHEN 'human' THEN 0 WHEN 'seed' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END"


NAMES = (
    "fx(k, fixture) AS (VALUES " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(FIXTURE_NAMES)) + "), "
    "names AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN fixture "
    "ELSE p_name || ' ' || fixture END AS product_name FROM part JOIN fx ON fx.k = p_partkey % 29)"
)

LB = (
    "lb AS (SELECT text AS product_name, source AS predicted_sub_category, lang AS category, "
    "(['seed','human','llm','batch_cache','vector','fuzzy','ml','keyword'])[(doc_id % 8) + 1] AS source, "
    "n_chars / 20000.0::DOUBLE AS confidence, (doc_id % 100) / 100.0::DOUBLE AS sub_confidence, "
    "doc_id % 5 = 0 AS corrected, doc_id AS seq FROM documents)"
)

W2 = (
    "w2 AS (SELECT * FROM (SELECT *, " + pri_train() + " AS pri2, row_number() OVER "
    "(PARTITION BY product_name ORDER BY " + pri_train() + ", seq) AS rn FROM lb) WHERE rn = 1)"
)

SEEDS = ("seeds(name, category, ord) AS (VALUES "
         + ", ".join(f"({_q(s)}, {_q(c)}, {i})" for i, (s, c) in enumerate(DEFAULT_SEEDS)) + ")")

# catalogue label table: seeds + one seed row per distinct part name
CATALOGUE = (
    SEEDS + ", "
    "cat_rows AS (SELECT p_name AS name, upper(substring(split_part(p_name, ' ', 2), 1, 1)) || "
    "lower(substring(split_part(p_name, ' ', 2), 2)) AS category, min(p_partkey) + 100 AS ord "
    "FROM part GROUP BY p_name), "
    "catalogue AS (SELECT name, category, ord FROM seeds UNION ALL SELECT name, category, ord FROM cat_rows)"
)

OUT = "product_name, predicted_sub_category, category, source, confidence, sub_confidence, corrected"


def grams_cte(name: str, src: str, id_col: str, text_col: str) -> str:
    return (
        f"{name}_w AS (SELECT {id_col} AS gid, unnest(regexp_split_to_array(lower({text_col}), '\\s+')) AS w FROM {src}), "
        f"{name}_p AS (SELECT gid, ' ' || w || ' ' AS p FROM {name}_w WHERE w <> ''), "
        f"{name}_n AS (SELECT gid, p, unnest(generate_series(2, least(4, length(p)))) AS n FROM {name}_p), "
        f"{name}_i AS (SELECT gid, p, n, unnest(generate_series(1, length(p) - n + 1)) AS i FROM {name}_n), "
        f"{name} AS (SELECT gid, substring(p, i, n) AS gram, count(*) AS cnt FROM {name}_i GROUP BY 1, 2)"
    )


def lcs_cte(pairs: str, out: str = "lcs") -> str:
    """``pairs(pid, a, b)`` → ``{out}(pid, lcs)``; strings up to 126 chars."""
    return (
        f"{out}_c AS (SELECT pid, a, unnest(generate_series(1, length(a))) AS i FROM {pairs}), "
        f"{out}_m AS (SELECT pid, substring(a, i, 1) AS c, bit_or((1::HUGEINT) << (i - 1)) AS m FROM {out}_c GROUP BY ALL), "
        f"{out}_s(pid, j, s) AS (SELECT pid, 0, ((1::HUGEINT) << length(a)) - 1 FROM {pairs} "
        f"UNION ALL SELECT st.pid, st.j + 1, "
        f"((st.s + (st.s & coalesce(m.m, 0::HUGEINT))) | (st.s - (st.s & coalesce(m.m, 0::HUGEINT)))) "
        f"& (((1::HUGEINT) << length(p.a)) - 1) "
        f"FROM {out}_s st JOIN {pairs} p ON p.pid = st.pid "
        f"LEFT JOIN {out}_m m ON m.pid = st.pid AND m.c = substring(p.b, st.j + 1, 1) "
        f"WHERE st.j < length(p.b)), "
        f"{out} AS (SELECT p.pid, length(p.a) - bit_count(st.s) AS lcs FROM {out}_s st JOIN {pairs} p "
        f"ON p.pid = st.pid AND st.j = length(p.b))"
    )


def ratio(lcs: str, a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs} / (length({a}) + length({b})) END)"


def token_set_parts(a: str, b: str) -> str:
    """Columns ta, tb, inter, da, db, si, sa, sb for two strings."""
    ta = f"list_distinct({tokens(a)})"
    tb = f"list_distinct({tokens(b)})"
    return (f"{ta} AS ta, {tb} AS tb")


def token_set_sql(src: str, key: str, a: str, b: str, out: str) -> str:
    """CTEs computing token-set ratio of (a, b) per ``key`` of ``src`` into
    ``{out}(key, tset)``."""
    return (
        f"{out}_t AS (SELECT {key} AS key, {token_set_parts(a, b)} FROM {src}), "
        f"{out}_d AS (SELECT key, ta, tb, list_sort(list_filter(ta, lambda x: list_contains(tb, x))) AS inter, "
        f"list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))) AS da, "
        f"list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))) AS db FROM {out}_t), "
        f"{out}_s AS (SELECT key, ta, tb, inter, da, db, array_to_string(inter, ' ') AS si, "
        f"array_to_string(da, ' ') AS sa, array_to_string(db, ' ') AS sb FROM {out}_d), "
        f"{out}_pairs AS (SELECT row_number() OVER () AS pid, sa AS a, sb AS b FROM (SELECT DISTINCT sa, sb FROM {out}_s)), "
        + lcs_cte(f"{out}_pairs", f"{out}_l") + ", "
        f"{out}_r AS (SELECT s.*, l.lcs FROM {out}_s s JOIN {out}_pairs p ON p.a = s.sa AND p.b = s.sb "
        f"JOIN {out}_l l ON l.pid = p.pid), "
        f"{out} AS (SELECT key, CASE "
        f"WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 "
        f"WHEN len(inter) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 100.0 "
        f"ELSE greatest("
        f"200.0 * (length(si) + (CASE WHEN len(inter) > 0 THEN 1 ELSE 0 END) + lcs) / "
        f"(2 * length(si) + 2 * (CASE WHEN len(inter) > 0 THEN 1 ELSE 0 END) + length(sa) + length(sb)), "
        f"CASE WHEN len(inter) > 0 THEN 200.0 * length(si) / (2 * length(si) + 1 + length(sa)) ELSE 0.0 END, "
        f"CASE WHEN len(inter) > 0 THEN 200.0 * length(si) / (2 * length(si) + 1 + length(sb)) ELSE 0.0 END) "
        f"END AS tset FROM {out}_r)"
    )


def refit_sql(x: str, qq: str, co: str) -> str:
    """Per query: TF-IDF refitted on its group's rows plus the query itself;
    ``{x}best(qid, x)`` with x = {c: sub, s: score}, all rows considered."""
    return (
        f"{x}qd AS (SELECT qid, 'q' AS did, text FROM {qq} UNION ALL SELECT q.qid, c.did, c.text FROM {qq} q JOIN {co} c ON c.grp = q.grp), "
        f"{x}qd_w AS (SELECT qid, did, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {x}qd), "
        f"{x}qd_p AS (SELECT qid, did, ' ' || w || ' ' AS p FROM {x}qd_w WHERE w <> ''), "
        f"{x}qd_n AS (SELECT qid, did, p, unnest(generate_series(2, least(4, length(p)))) AS n FROM {x}qd_p), "
        f"{x}qd_i AS (SELECT qid, did, p, n, unnest(generate_series(1, length(p) - n + 1)) AS i FROM {x}qd_n), "
        f"{x}qd_c AS (SELECT qid, did, substring(p, i, n) AS gram, count(*) AS cnt FROM {x}qd_i GROUP BY 1, 2, 3), "
        f"{x}qn AS (SELECT qid, count(*)::DOUBLE AS n FROM {x}qd GROUP BY qid), "
        f"{x}qdf AS (SELECT qid, gram, count(*) AS df FROM {x}qd_c GROUP BY 1, 2), "
        f"{x}qw0 AS (SELECT c.qid, c.did, c.gram, (1 + ln(c.cnt)) * (ln((1 + qn.n) / (1 + f.df)) + 1) AS w FROM {x}qd_c c "
        f"JOIN {x}qdf f ON f.qid = c.qid AND f.gram = c.gram JOIN {x}qn qn ON qn.qid = c.qid), "
        f"{x}qw AS (SELECT qid, did, gram, w / sqrt(sum(w * w) OVER (PARTITION BY qid, did)) AS w FROM {x}qw0), "
        f"{x}dots AS (SELECT a.qid, b.did, sum(a.w * b.w) AS s FROM {x}qw a JOIN {x}qw b ON a.qid = b.qid AND a.gram = b.gram "
        f"AND a.did = 'q' AND b.did <> 'q' GROUP BY 1, 2), "
        f"{x}allc AS (SELECT q.qid, c.did, c.ord, c.sub, coalesce(d.s, 0.0) AS s FROM {qq} q JOIN {co} c ON c.grp = q.grp "
        f"LEFT JOIN {x}dots d ON d.qid = q.qid AND d.did = c.did), "
        f"{x}best AS (SELECT qid, arg_min({{'c': sub, 's': s}}, {{'ns': -round(s, 12), 'o': ord}}) AS x FROM {x}allc GROUP BY qid)"
    )


def keyword_sql(x: str, pc: str) -> str:
    """J8 per (key, candidate) of ``pc(key, nl, candidate, cl, cand_ord)`` →
    ``{x}kw(key, x)`` with the best candidate (score > 0)."""
    from .config import STYLE_ALIASES, SUB_SKIP_WORDS
    alias_rows = [f"({_q(c)}, {_q(a)})" for c, als in STYLE_ALIASES.items() for a in als]
    skip = "[" + ", ".join(_q(w) for w in SUB_SKIP_WORDS) + "]"
    return (
        f"{x}al(candidate, alias) AS (VALUES " + ", ".join(alias_rows) + "), "
        f"{x}a2 AS (SELECT pc.key, pc.candidate, max(length(al.alias)) AS m FROM {pc} pc JOIN {x}al al "
        f"ON al.candidate = pc.candidate WHERE list_contains(regexp_extract_all(pc.nl, '[\\p{{L}}\\p{{N}}_]+'), al.alias) "
        f"GROUP BY 1, 2), "
        f"{x}bw AS (SELECT pc.*, list_filter(regexp_extract_all(cl, '[a-z]+'), lambda w: length(w) >= 4 AND NOT list_contains("
        + skip + f", w)) AS cw, regexp_extract_all(nl, '[a-z]+') AS nw FROM {pc} pc), "
        f"{x}bm AS (SELECT *, list_filter(cw, lambda c: len(list_filter(nw, lambda n: length(n) >= 4 AND "
        f"(starts_with(n, substring(c, 1, 5)) OR starts_with(c, substring(n, 1, 5))))) > 0) AS mt FROM {x}bw), "
        f"{x}sc AS (SELECT bm.key, bm.candidate, bm.cand_ord, CASE WHEN strpos(bm.nl, bm.cl) > 0 THEN 100 + length(bm.cl) "
        f"WHEN a2.m IS NOT NULL THEN 90 + a2.m ELSE len(bm.mt) * 10 + coalesce(list_sum(list_transform(bm.mt, "
        f"lambda x: length(x))), 0) END AS s FROM {x}bm bm LEFT JOIN {x}a2 a2 ON a2.key = bm.key AND a2.candidate = bm.candidate), "
        f"{x}kw AS (SELECT key, arg_min({{'c': candidate, 's': s}}, {{'ns': -s, 'o': cand_ord}}) AS x FROM {x}sc "
        f"WHERE s > 0 GROUP BY key)"
    )


def _known_prompt_list() -> str:
    return ("(SELECT string_agg('  ' || CAST(rn AS VARCHAR) || '. ' || category, chr(10) ORDER BY rn) "
            "FROM (SELECT category, row_number() OVER (ORDER BY category) AS rn "
            "FROM (SELECT DISTINCT category FROM catalogue)))")


def tfidf_weights(counts: str, ndocs: str, out: str, vocab: str | None = None) -> str:
    """Weights from ``counts(gid, gram, cnt)``; ``vocab(gram, df)`` if capped."""
    df = vocab or f"(SELECT gram, count(*) AS df FROM {counts} GROUP BY gram)"
    return (
        f"{out}_raw AS (SELECT c.gid, c.gram, (1 + ln(c.cnt)) * (ln((1 + {ndocs}) / (1 + v.df)) + 1) AS w "
        f"FROM {counts} c JOIN {df} v ON v.gram = c.gram), "
        f"{out} AS (SELECT r.gid, r.gram, r.w / sqrt(sum(r.w * r.w) OVER (PARTITION BY r.gid)) AS w FROM {out}_raw r)"
    )


def _vector_common() -> str:
    """Brand-catalogue index (seeds + distinct ``p_name p_brand``) and the
    names' cleaned lookups as queries; all cosines by a brute-force join."""
    bc_name = "p_name || ' ' || p_brand"
    return (
        "WITH " + NAMES + ", " + SEEDS + ", "
        "bc_rows AS (SELECT " + bc_name + " AS name, upper(substring(split_part(" + bc_name + ", ' ', 2), 1, 1)) || "
        "lower(substring(split_part(" + bc_name + ", ' ', 2), 2)) AS category, min(p_partkey) + 100 AS ord "
        "FROM part GROUP BY 1), "
        "d AS (SELECT ord AS gid, name AS text, category, name AS sub, ord FROM seeds "
        "UNION ALL SELECT ord, name, category, name, ord FROM bc_rows), "
        + grams_cte("dc", "d", "gid", "text") + ", "
        "voc AS (SELECT gram, count(*) AS df FROM dc GROUP BY gram ORDER BY sum(cnt) DESC, gram LIMIT 20000), "
        "nd AS (SELECT count(*)::DOUBLE AS n FROM d), "
        + tfidf_weights("dc", "(SELECT n FROM nd)", "dw", "voc") + ", "
        "u AS (SELECT DISTINCT " + strip("product_name") + " AS name FROM names), "
        "qq AS (SELECT name AS qid, " + clean("name") + " AS text FROM u), "
        + grams_cte("qc", "qq", "qid", "text") + ", "
        + tfidf_weights("qc", "(SELECT n FROM nd)", "qw", "voc") + ", "
        "sc AS (SELECT qw.gid AS qid, dw.gid AS did, sum(qw.w * dw.w) AS score "
        "FROM qw JOIN dw ON qw.gram = dw.gram GROUP BY 1, 2), "
        "sco AS (SELECT sc.*, d.ord, d.category, d.sub FROM sc JOIN d ON d.gid = sc.did)"
    )


def _sub_pairs() -> str:
    return (NAMES + ", " + CATALOGUE + ", "
            "sp AS (SELECT row_id, " + strip("product_name") + " AS name, "
            "(['Beer','Hard Beverage','Non-alcoholic Beer'])[(row_id % 3) + 1] AS category FROM names), "
            "cands AS (SELECT lower(category) AS cat_key, name AS candidate, ord AS cand_ord FROM catalogue)")


def _brand_pairs() -> str:
    """Names with their part's noun as category; candidates of the brand catalogue."""
    bc_name = "p_name || ' ' || p_brand"
    noun = "upper(substring(split_part({0}, ' ', 2), 1, 1)) || lower(substring(split_part({0}, ' ', 2), 2))"
    return (NAMES + ", " + SEEDS + ", "
            "sp AS (SELECT row_id, " + strip("product_name") + " AS name, " + noun.format("p_name") + " AS category "
            "FROM names JOIN part ON p_partkey = row_id), "
            "cands AS (SELECT lower(category) AS cat_key, name AS candidate, ord AS cand_ord FROM seeds UNION ALL "
            "SELECT lower(" + noun.format("p_name") + "), " + bc_name + ", min(p_partkey) + 100 FROM part GROUP BY p_name, p_brand)")


def _tag_sources_known() -> str:
    return "(SELECT DISTINCT category FROM catalogue)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    nm = strip("product_name")
    q["hint_gate"] = (
        "WITH " + NAMES + ", h AS (SELECT row_id, " + hint(nm) + " AS hint FROM names) "
        "SELECT row_id, hint, CASE WHEN hint IN ('Beer', 'Hard Beverage', 'Non-alcoholic Beer') "
        "THEN hint END AS keyword_category FROM h")
    q["clean_lookup"] = (
        "WITH " + NAMES + ", c AS (SELECT row_id, " + clean(nm) + " AS lookup FROM names) "
        "SELECT row_id, lookup, lower(" + strip("lookup") + ") AS lookup_key FROM c")
    q["dedup_priority"] = (
        "WITH " + LB + " SELECT " + OUT + ", seq AS kept_seq FROM (SELECT *, row_number() OVER "
        "(PARTITION BY product_name ORDER BY " + pri_save() + ", seq) AS rn FROM lb) WHERE rn = 1")
    q["dedup_training"] = (
        "WITH " + LB + ", " + W2 + " SELECT product_name, category, source, seq AS kept_seq, "
        "pri2 AS train_priority FROM w2")
    q["lookup_keys"] = (
        "WITH " + LB + ", " + W2 + " SELECT lower(product_name) AS key, "
        "arg_max(category, pri2 * 1000000000000 + seq) AS category, "
        "arg_min(pri2, pri2 * 1000000000000 + seq) AS key_priority, "
        "arg_min(seq, pri2 * 1000000000000 + seq) AS key_seq FROM w2 GROUP BY 1")
    q["coerce_rename"] = (
        "SELECT doc_id, text AS product_name, "
        "TRY_CAST(CASE WHEN doc_id % 7 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) || 'e-4' END AS DOUBLE) AS confidence, "
        "TRY_CAST('0.' || CAST(doc_id % 10 AS VARCHAR) AS DOUBLE) AS sub_confidence, "
        "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS corrected FROM documents")
    seed_name = ("CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' ' ELSE p_name END")
    q["seed_insert"] = (
        "WITH " + LB + ", "
        "s AS (SELECT " + strip(seed_name) + " AS name, " + strip("p_type") + " AS cat, p_partkey AS ord FROM part), "
        "f AS (SELECT lower(name) AS key, arg_min(name, ord) AS name, arg_min(cat, ord) AS cat, min(ord) AS ord "
        "FROM s GROUP BY 1), "
        "fresh AS (SELECT * FROM f WHERE key NOT IN (SELECT lower(product_name) FROM lb WHERE product_name IS NOT NULL)), "
        "a AS (SELECT product_name, predicted_sub_category, category, source, confidence, sub_confidence, corrected, seq FROM lb "
        "UNION ALL SELECT name, name, cat, 'seed', NULL, NULL, false, 100000000000 + ord FROM fresh) "
        "SELECT " + OUT + " FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY "
        + pri_save() + ", seq) AS rn FROM a) WHERE rn = 1")
    merge_tail = (
        "tab AS (SELECT *, lower(product_name) AS key FROM lb), "
        "auth AS (SELECT key, max(CASE WHEN source IN ('seed', 'human') THEN 1 ELSE 0 END) AS auth FROM tab "
        "WHERE key IN (SELECT key FROM inc) GROUP BY key), "
        "inc2 AS (SELECT inc.*, auth.auth FROM inc LEFT JOIN auth USING (key) {skip}), ")
    preds = (
        "p AS (SELECT text AS product_name, lang || '-v2' AS category, 'ml' AS source, 0.5::DOUBLE AS confidence, "
        "source AS predicted_sub_category, 0.6::DOUBLE AS sub_confidence, doc_id AS ord FROM documents "
        "UNION ALL SELECT text, 'bench', 'llm', 0.7::DOUBLE, 'b', 0.8::DOUBLE, item_id + (SELECT max(doc_id) + 1 FROM documents) FROM benchmark), "
        "inc AS (SELECT lower(" + strip("product_name") + ") AS key, arg_min(" + strip("product_name") + ", ord) AS first_name, "
        "arg_max({'c': " + strip("category") + ", 's': source, 'f': confidence, "
        "'u': " + strip("coalesce(predicted_sub_category, '')") + ", 'g': sub_confidence}, ord) AS v, "
        "min(ord) AS i_ord FROM p GROUP BY 1), ")
    q["prediction_merge"] = (
        "WITH " + LB + ", " + preds + merge_tail.format(skip="WHERE coalesce(auth.auth, 0) = 0") +
        "upd AS (SELECT t.product_name, CASE WHEN i.key IS NOT NULL THEN i.v.u ELSE t.predicted_sub_category END AS predicted_sub_category, "
        "CASE WHEN i.key IS NOT NULL THEN i.v.c ELSE t.category END AS category, "
        "CASE WHEN i.key IS NOT NULL THEN i.v.s ELSE t.source END AS source, "
        "CASE WHEN i.key IS NOT NULL THEN i.v.f ELSE t.confidence END AS confidence, "
        "CASE WHEN i.key IS NOT NULL THEN i.v.g ELSE t.sub_confidence END AS sub_confidence, "
        "t.corrected, t.seq FROM tab t LEFT JOIN (SELECT * FROM inc2 WHERE auth IS NOT NULL) i ON i.key = t.key), "
        "ins AS (SELECT first_name AS product_name, v.u AS predicted_sub_category, v.c AS category, v.s AS source, "
        "v.f AS confidence, v.g AS sub_confidence, false AS corrected, 100000000000 + i_ord AS seq "
        "FROM inc2 WHERE auth IS NULL), "
        "a AS (SELECT * FROM upd UNION ALL SELECT * FROM ins) "
        "SELECT " + OUT + " FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY "
        + pri_save() + ", seq) AS rn FROM a) WHERE rn = 1")
    corr = (
        "p AS (SELECT d.text AS product_name, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS category, "
        "d.doc_id AS ord FROM documents d JOIN labels l ON l.doc_id = d.doc_id "
        "UNION ALL SELECT text, 'passage', item_id + (SELECT max(doc_id) + 1 FROM documents) FROM benchmark), "
        "inc AS (SELECT lower(" + strip("product_name") + ") AS key, arg_min(" + strip("product_name") + ", ord) AS first_name, "
        "arg_max(" + strip("category") + ", ord) AS i_category, min(ord) AS i_ord FROM p GROUP BY 1), ")
    q["correction_merge"] = (
        "WITH " + LB + ", " + corr + merge_tail.format(skip="") +
        "upd AS (SELECT t.product_name, t.predicted_sub_category, "
        "CASE WHEN i.key IS NOT NULL THEN i.i_category ELSE t.category END AS category, "
        "CASE WHEN i.key IS NOT NULL THEN 'human' ELSE t.source END AS source, "
        "CASE WHEN i.key IS NOT NULL THEN 1.0::DOUBLE ELSE t.confidence END AS confidence, "
        "CASE WHEN i.key IS NOT NULL THEN 1.0::DOUBLE ELSE t.sub_confidence END AS sub_confidence, "
        "CASE WHEN i.key IS NOT NULL THEN true ELSE t.corrected END AS corrected, t.seq "
        "FROM tab t LEFT JOIN (SELECT * FROM inc2 WHERE auth IS NOT NULL) i ON i.key = t.key), "
        "ins AS (SELECT first_name AS product_name, first_name AS predicted_sub_category, i_category AS category, "
        "'human' AS source, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS sub_confidence, true AS corrected, "
        "100000000000 + i_ord AS seq FROM inc2 WHERE auth IS NULL), "
        "a AS (SELECT * FROM upd UNION ALL SELECT * FROM ins) "
        "SELECT " + OUT + " FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY "
        + pri_save() + ", seq) AS rn FROM a) WHERE rn = 1")
    q["table_stats"] = (
        "WITH " + LB + " SELECT count(*) AS total_rows, count(DISTINCT category) AS unique_categories, "
        "coalesce(sum(corrected::BIGINT), 0)::BIGINT AS human_corrections FROM lb")
    q["source_counts"] = "WITH " + LB + " SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) AS place FROM lb GROUP BY source"
    q["category_dist"] = "WITH " + LB + " SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category NULLS FIRST) AS place FROM lb GROUP BY category"
    q["known_categories"] = "WITH " + LB + " SELECT DISTINCT category FROM lb WHERE category IS NOT NULL"
    q["new_samples"] = (
        "WITH " + LB + ", c AS (SELECT count(*) AS new_samples FROM lb WHERE source IN ('ml','llm','vector','fuzzy')) "
        "SELECT new_samples, 20 AS threshold, new_samples >= 20 AS retrain FROM c")
    q["class_counts"] = (
        "WITH " + LB + ", " + W2 + ", c AS (SELECT category AS label, count(*) AS n FROM w2 GROUP BY 1) "
        "SELECT label, n, count(*) OVER () AS n_classes, min(n) OVER () AS min_count, "
        "least(5, min(n) OVER ()) AS cv_folds FROM c")
    q["exact_lookup"] = (
        "WITH " + LB + ", " + W2 + ", "
        "q AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' 12 x 330ml' END AS product_name "
        "FROM documents UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), text FROM benchmark), "
        "u AS (SELECT row_id, " + strip("product_name") + " AS name FROM q), "
        "u2 AS (SELECT row_id, name, " + clean("name") + " AS lookup FROM u), "
        "keys AS (SELECT * FROM (SELECT lower(product_name) AS key, arg_max(category, pri2 * 1000000000000 + seq) AS category "
        "FROM w2 GROUP BY 1) WHERE category IS NOT NULL AND category <> '') "
        "SELECT u2.row_id, coalesce(k1.category, k2.category) AS exact_category FROM u2 "
        "LEFT JOIN keys k1 ON k1.key = lower(u2.name) LEFT JOIN keys k2 ON k2.key = lower(u2.lookup)")
    q["char_grams"] = ("WITH " + grams_cte("g", "benchmark", "item_id", "text") +
                       " SELECT gid AS item_id, gram, cnt FROM g")
    q["vocabulary"] = (
        "WITH " + grams_cte("g", "documents", "doc_id", "text") +
        " SELECT gram, sum(cnt)::BIGINT AS tf, count(*) AS df FROM g GROUP BY gram ORDER BY tf DESC, gram LIMIT 20000")
    q["tfidf_weights"] = (
        "WITH " + grams_cte("g", "benchmark", "item_id", "text") + ", "
        + tfidf_weights("g", "(SELECT count(*)::DOUBLE FROM benchmark)", "tw") +
        " SELECT gid AS item_id, gram, round(w, 6) AS weight FROM tw")
    q["vector_match"] = (
        _vector_common() + ", b AS (SELECT qid, arg_min({'c': category, 'm': sub, 'v': score}, "
        "{'ns': -round(score, 12), 'o': ord}) AS x FROM sco WHERE score >= 0.8 GROUP BY qid) "
        "SELECT n.row_id, b.x.c AS category, b.x.m AS matched, round(b.x.v, 6) AS score FROM names n "
        "JOIN b ON b.qid = " + strip("n.product_name"))
    q["vector_topk"] = (
        _vector_common() + " SELECT qid AS name, rank, sub AS matched, round(score, 6) AS score FROM "
        "(SELECT qid, sub, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS rank "
        "FROM sco) WHERE rank <= 5")
    q["token_sort"] = (
        "WITH RECURSIVE " + NAMES + ", "
        "t AS (SELECT n.row_id, " + sort_tokens("lower(" + clean(nm) + ")") + " AS a, "
        + sort_tokens("lower(p.p_type || ' ' || p.p_name)") + " AS b FROM names n JOIN part p ON p.p_partkey = n.row_id), "
        "pr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM t)), "
        + lcs_cte("pr") +
        " SELECT t.row_id, round(" + ratio("lcs.lcs", "t.a", "t.b") + ", 6) AS ratio FROM t "
        "JOIN pr ON pr.a = t.a AND pr.b = t.b JOIN lcs ON lcs.pid = pr.pid")
    q["token_set"] = (
        "WITH RECURSIVE " + NAMES + ", "
        "src AS (SELECT n.row_id, lower(" + strip_generic(nm) + ") AS a, lower("
        + strip_generic("p.p_name || ' beer'") + ") AS b FROM names n JOIN part p ON p.p_partkey = n.row_id), "
        + token_set_sql("src", "row_id", "a", "b", "ts") +
        " SELECT key AS row_id, round(tset, 6) AS ratio FROM ts")
    q["fuzzy_match"] = (
        "WITH RECURSIVE " + NAMES + ", " + CATALOGUE + ", "
        "keys AS (SELECT lower(name) AS key, category, ord FROM catalogue), "
        "u AS (SELECT DISTINCT " + nm + " AS name FROM names), "
        "ul AS (SELECT name, " + sort_tokens("lower(" + clean("name") + ")") + " AS a FROM u), "
        "pr0 AS (SELECT ul.name, k.key, k.category, k.ord, ul.a, " + sort_tokens("k.key") + " AS b FROM ul, keys k), "
        "pr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM pr0)), "
        + lcs_cte("pr") + ", "
        "sc AS (SELECT pr0.name, pr0.category, pr0.ord, " + ratio("lcs.lcs", "pr0.a", "pr0.b") + " AS r FROM pr0 "
        "JOIN pr ON pr.a = pr0.a AND pr.b = pr0.b JOIN lcs ON lcs.pid = pr.pid), "
        "best AS (SELECT name, arg_min({'c': category, 'r': r}, {'nr': -r, 'o': ord}) AS x FROM sc WHERE r >= 85 GROUP BY name) "
        "SELECT n.row_id, best.x.c AS category, round(best.x.r / 100.0, 6) AS score FROM names n "
        "JOIN best ON best.name = " + strip("n.product_name"))
    q["sub_keyword"] = (
        "WITH " + _sub_pairs() + ", "
        "pc AS (SELECT sp.row_id AS key, lower(sp.name) AS nl, c.candidate, lower(c.candidate) AS cl, c.cand_ord "
        "FROM sp JOIN cands c ON c.cat_key = lower(sp.category)), "
        + keyword_sql("k_", "pc") +
        " SELECT key AS row_id, x.c AS sub_category, x.s::INTEGER AS score FROM k_kw")
    q["seed_json"] = "SELECT p_name || ' \"' || p_brand || '\"' AS sub_category, p_type AS category FROM part"
    q["sub_keyword_brands"] = (
        "WITH " + _brand_pairs() + ", "
        "up AS (SELECT DISTINCT name, category FROM sp), "
        "pc AS (SELECT up.name || '|' || up.category AS key, lower(up.name) AS nl, c.candidate, lower(c.candidate) AS cl, c.cand_ord "
        "FROM up JOIN cands c ON c.cat_key = lower(up.category)), "
        + keyword_sql("k_", "pc") +
        " SELECT row_id, x.c AS sub_category, x.s::INTEGER AS score FROM k_kw JOIN sp ON key = sp.name || '|' || sp.category")
    q["sub_fuzzy"] = (
        "WITH RECURSIVE " + _sub_pairs() + ", "
        "pc AS (SELECT sp.row_id || '|' || c.candidate AS k, sp.row_id, c.candidate, c.cand_ord, "
        "lower(" + strip_generic(clean("sp.name")) + ") AS a, lower(" + strip_generic("c.candidate") + ") AS b "
        "FROM sp JOIN cands c ON c.cat_key = lower(sp.category)), "
        + token_set_sql("pc", "k", "a", "b", "ts") + ", "
        "sc AS (SELECT pc.row_id, pc.candidate, pc.cand_ord, ts.tset / 100.0 AS s FROM pc JOIN ts ON ts.key = pc.k) "
        "SELECT row_id, x.c AS sub_category, round(x.s, 6) AS score FROM (SELECT row_id, arg_min({'c': candidate, 's': s}, "
        "{'ns': -s, 'o': cand_ord}) AS x FROM sc GROUP BY row_id)")
    refit = refit_sql("", "qq", "co") + " "
    q["sub_vector"] = (
        "WITH " + _sub_pairs() + ", "
        "qq AS (SELECT DISTINCT name || chr(1) || category AS qid, lower(category) AS grp, " + clean("name") + " AS text FROM sp), "
        "co AS (SELECT cat_key AS grp, cat_key || chr(1) || candidate AS did, cand_ord AS ord, candidate AS sub, candidate AS text FROM cands), "
        + refit +
        "SELECT sp.row_id, best.x.c AS sub_category, round(best.x.s, 6) AS score FROM sp "
        "JOIN best ON best.qid = sp.name || chr(1) || sp.category")
    q["dataset_sim"] = (
        "WITH " + _sub_pairs() + ", "
        "rel AS (SELECT lower(category) AS grp, name AS text, name AS sub, ord FROM catalogue), "
        "relg AS (SELECT grp FROM rel GROUP BY grp HAVING count(*) >= 2), "
        "qq AS (SELECT DISTINCT name || chr(1) || category AS qid, lower(category) AS grp, name AS text FROM sp "
        "WHERE lower(category) IN (SELECT grp FROM relg)), "
        "co AS (SELECT grp, grp || chr(1) || text AS did, ord, sub, text FROM rel), "
        + refit +
        "SELECT sp.row_id, best.x.c AS sub_category, round(best.x.s, 6) AS score FROM sp "
        "JOIN best ON best.qid = sp.name || chr(1) || sp.category")
    sysp = _q(CATEGORY_SYSTEM_PROMPT)
    q["llm_requests"] = (
        "WITH " + NAMES + ", " + CATALOGUE + ", u AS (SELECT DISTINCT " + nm + " AS name FROM names) "
        "SELECT sha256(name) AS request_id, name AS product_name, " + sysp + " AS system_prompt, "
        "'Available categories:' || chr(10) || " + _known_prompt_list() + " || chr(10) || chr(10) || "
        "'Product name: \"' || name || '\"' || chr(10) || chr(10) || 'Return JSON only.' AS user_prompt FROM u")
    known_sorted = "(SELECT list(category ORDER BY category) FROM (SELECT DISTINCT category FROM catalogue))"
    q["llm_replies"] = (
        "WITH RECURSIVE " + NAMES + ", " + CATALOGUE + ", "
        "ev AS (SELECT e.event_id, " + strip("n.product_name") + " AS name, e.event_type FROM names n "
        "JOIN events e ON e.event_id % (SELECT count(*) FROM part) = n.row_id % (SELECT count(*) FROM part)), "
        "rep AS (SELECT sha256(name) AS request_id, event_id, CASE "
        "WHEN event_type = 'view' THEN 'Sure: {\"category\": \"beer\", \"confidence\": 0.' || CAST(event_id % 10 AS VARCHAR) || '} ok' "
        "WHEN event_type = 'click' THEN '{\"category\": \"Hard Beverages\"}' "
        "WHEN event_type = 'purchase' THEN '{\"category\": \" Ring \", \"confidence\": 0.' || CAST(event_id % 10 AS VARCHAR) || '}' "
        "WHEN event_type = 'error' THEN 'no idea' "
        "ELSE '{\"category\": \"' || event_type || '\", \"confidence\": \"high\"}' END AS reply FROM ev), "
        "first AS (SELECT request_id, arg_min(reply, event_id) AS reply FROM rep GROUP BY 1), "
        "u AS (SELECT DISTINCT " + nm + " AS name FROM names), "
        "j AS (SELECT u.name, regexp_extract(f.reply, '(?s)\\{.*?\\}') AS js FROM u JOIN first f ON f.request_id = sha256(u.name)), "
        "p AS (SELECT name, " + strip("coalesce(json_extract_string(js, '$.category'), '')") + " AS cat, "
        "json_extract_string(js, '$.confidence') AS rc FROM j WHERE js <> '' AND json_valid(js)), "
        "p2 AS (SELECT name, cat, CASE WHEN rc IS NULL THEN 0.5 ELSE TRY_CAST(rc AS DOUBLE) END AS conf FROM p), "
        "p3 AS (SELECT * FROM p2 WHERE conf IS NOT NULL), "
        "kn AS (SELECT category, lower(category) AS lc, row_number() OVER (ORDER BY category) AS o FROM (SELECT DISTINCT category FROM catalogue)), "
        "canon AS (SELECT lc, arg_max(category, o) AS c FROM kn GROUP BY lc), "
        "miss AS (SELECT p3.* FROM p3 LEFT JOIN canon ON canon.lc = lower(p3.cat) WHERE canon.c IS NULL), "
        "pr0 AS (SELECT m.name, m.cat AS a0, kn.category, kn.o, " + sort_tokens("m.cat") + " AS a, "
        + sort_tokens("kn.category") + " AS b FROM miss m, kn), "
        "pr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM pr0)), "
        + lcs_cte("pr") + ", "
        "fz AS (SELECT pr0.name, arg_min(pr0.category, {'nr': -" + ratio("lcs.lcs", "pr0.a", "pr0.b") + ", 'o': pr0.o}) AS c "
        "FROM pr0 JOIN pr ON pr.a = pr0.a AND pr.b = pr0.b JOIN lcs ON lcs.pid = pr.pid GROUP BY pr0.name) "
        "SELECT sha256(p3.name) AS request_id, coalesce(canon.c, fz.c) AS llm_cat, "
        "round(CASE WHEN canon.c IS NOT NULL THEN p3.conf ELSE greatest(0.1, p3.conf - 0.2) END, 6) AS llm_conf "
        "FROM p3 LEFT JOIN canon ON canon.lc = lower(p3.cat) LEFT JOIN fz ON fz.name = p3.name")
    q["sub_requests"] = (
        "WITH " + _sub_pairs() + ", "
        "u AS (SELECT DISTINCT name, category FROM sp), "
        "cl AS (SELECT cat_key, string_agg('  ' || CAST(rn AS VARCHAR) || '. ' || candidate, chr(10) ORDER BY rn) AS lst "
        "FROM (SELECT cat_key, candidate, row_number() OVER (PARTITION BY cat_key ORDER BY cand_ord) AS rn FROM cands) GROUP BY cat_key) "
        "SELECT sha256(u.name || chr(1) || u.category) AS request_id, u.name AS product_name, u.category, "
        "'Product: \"' || u.name || '\"' || chr(10) || 'Category: ' || u.category || chr(10) || chr(10) || "
        "'Known sub-categories:' || chr(10) || cl.lst || chr(10) || chr(10) || "
        "'Pick the BEST matching sub-category from the list above.' || chr(10) || "
        "'Return ONLY JSON: {\"sub_category\": \"<exact name from list>\"}' AS user_prompt "
        "FROM u JOIN cl ON cl.cat_key = lower(u.category)")
    q["label_store"] = (
        "WITH " + LB + " SELECT " + OUT + ", row_number() OVER (ORDER BY " + pri_save() + ", old) - 1 AS seq FROM "
        "(SELECT *, seq AS old, row_number() OVER (PARTITION BY product_name ORDER BY " + pri_save() + ", seq) AS rn FROM lb) WHERE rn = 1")
    q["batch_csv"] = "SELECT doc_id, coalesce(text, '') AS product_name, lang FROM documents"
    q["index_store"] = q["tfidf_weights"]
    q["model_store"] = ("WITH " + NAMES + " SELECT min(row_id) AS rid, true AS same FROM (SELECT row_id, " + nm + " AS name FROM names) "
                        "WHERE " + hint("name") + " IS NOT NULL GROUP BY name")
    q["model_quality"] = ("WITH " + LB + ", " + W2 + " SELECT classifier, count(*) AS n, true AS better_than_majority, true AS probable "
                          "FROM w2, (VALUES ('linear'), ('boosted')) AS k(classifier) WHERE seq % 5 = 0 GROUP BY classifier")
    q["retrain_rule"] = ("WITH " + LB + " SELECT 'skipped' AS status, count(*) AS new_samples, 1073741824::BIGINT AS threshold FROM lb "
                         "WHERE source IN ('ml','llm','vector','fuzzy') UNION ALL SELECT 'no_data', NULL, NULL")
    q["sub_replies"] = (
        "WITH " + _sub_pairs() + ", "
        "ev AS (SELECT e.event_id, s.name, s.category, e.event_type FROM sp s JOIN events e "
        "ON e.event_id % (SELECT count(*) FROM part) = s.row_id % (SELECT count(*) FROM part)), "
        "f AS (SELECT name, category, arg_min(event_type, event_id) AS t FROM ev GROUP BY 1, 2), "
        "x AS (SELECT name, category, CASE t WHEN 'view' THEN 'craft BEER' WHEN 'click' THEN 'New Thing' WHEN 'purchase' THEN NULL "
        "WHEN 'error' THEN NULL ELSE t END AS sc FROM f) "
        "SELECT sha256(x.name || chr(1) || x.category) AS request_id, coalesce(c.candidate, x.sc) AS llm_sub FROM x "
        "LEFT JOIN (SELECT cat_key, lower(candidate) AS lc, arg_max(candidate, cand_ord) AS candidate FROM cands GROUP BY 1, 2) c "
        "ON c.cat_key = lower(x.category) AND c.lc = lower(x.sc) WHERE x.sc IS NOT NULL")
    q["stats_report"] = (
        "WITH " + CATALOGUE + ", t AS (SELECT lower(name) AS k, arg_min(category, ord) AS category FROM catalogue GROUP BY 1) "
        "SELECT 'stats' AS part, 'total_rows' AS key, count(*) AS n, NULL::BIGINT AS place FROM t UNION ALL "
        "SELECT 'stats', 'unique_categories', count(DISTINCT category), NULL FROM t UNION ALL "
        "SELECT 'stats', 'human_corrections', 0, NULL UNION ALL "
        "SELECT 'sources', 'seed', count(*), 1 FROM t UNION ALL "
        "SELECT 'categories', category, count(*), row_number() OVER (ORDER BY count(*) DESC, category NULLS FIRST) FROM t GROUP BY category")
    return q


def _category_chain() -> str:
    """CTEs from distinct names ``u(name)`` to ``cat(name, lookup, source,
    category, confidence)`` with the catalogue label table."""
    fr = ratio("flcs.lcs", "f0.a", "f0.b")
    return (
        "u1 AS (SELECT name, " + hint("name") + " AS hint, " + clean("name") + " AS lookup FROM u), "
        "keys AS (SELECT lower(name) AS key, category, ord FROM catalogue), "
        "known AS (SELECT DISTINCT category FROM catalogue), "
        "ex AS (SELECT u1.*, coalesce(k1.category, k2.category) AS exact_cat, "
        "CASE WHEN u1.hint IN (SELECT category FROM known) THEN u1.hint END AS kw_cat FROM u1 "
        "LEFT JOIN keys k1 ON k1.key = lower(u1.name) LEFT JOIN keys k2 ON k2.key = lower(u1.lookup)), "
        # fuzzy (token-sort ≥ 85, first key on ties)
        "f0 AS (SELECT ex.name, k.category, k.ord, " + sort_tokens("lower(ex.lookup)") + " AS a, "
        + sort_tokens("k.key") + " AS b FROM ex, keys k), "
        "fpr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM f0)), "
        + lcs_cte("fpr", "flcs") + ", "
        "fsc AS (SELECT f0.name, f0.category, f0.ord, " + fr + " AS r FROM f0 JOIN fpr ON fpr.a = f0.a AND fpr.b = f0.b "
        "JOIN flcs ON flcs.pid = fpr.pid), "
        "fz AS (SELECT name, arg_min({'c': category, 'r': r}, {'nr': -r, 'o': ord}) AS x FROM fsc WHERE r >= 85 GROUP BY name), "
        # vector index over the catalogue (cosine ≥ 0.80)
        "d AS (SELECT ord AS gid, name AS text, category, ord FROM catalogue), "
        + grams_cte("dc", "d", "gid", "text") + ", "
        "voc AS (SELECT gram, count(*) AS df FROM dc GROUP BY gram ORDER BY sum(cnt) DESC, gram LIMIT 20000), "
        "nd AS (SELECT count(*)::DOUBLE AS n FROM d), "
        + tfidf_weights("dc", "(SELECT n FROM nd)", "dw", "voc") + ", "
        "vq AS (SELECT name AS qid, lookup AS text FROM ex), "
        + grams_cte("vqc", "vq", "qid", "text") + ", "
        + tfidf_weights("vqc", "(SELECT n FROM nd)", "vqw", "voc") + ", "
        "vsc AS (SELECT vqw.gid AS name, dw.gid AS did, sum(vqw.w * dw.w) AS score FROM vqw JOIN dw ON vqw.gram = dw.gram "
        "GROUP BY 1, 2), "
        "vb AS (SELECT vsc.name, arg_min({'c': d.category, 's': vsc.score}, {'ns': -round(vsc.score, 12), 'o': d.ord}) AS x "
        "FROM vsc JOIN d ON d.gid = vsc.did WHERE vsc.score >= 0.8 GROUP BY vsc.name), "
        "cat AS (SELECT ex.name, ex.lookup, "
        "CASE WHEN exact_cat IS NOT NULL THEN 'dataset' WHEN kw_cat IS NOT NULL THEN 'keyword' "
        "WHEN fz.x IS NOT NULL THEN 'fuzzy' WHEN vb.x IS NOT NULL THEN 'vector' ELSE 'fallback' END AS source, "
        "coalesce(exact_cat, kw_cat, fz.x.c, vb.x.c, (SELECT min(category) FROM known)) AS category, "
        "CASE WHEN exact_cat IS NOT NULL THEN 1.0 WHEN kw_cat IS NOT NULL THEN 0.9 WHEN fz.x IS NOT NULL THEN fz.x.r / 100.0 "
        "WHEN vb.x IS NOT NULL THEN vb.x.s ELSE 0.0 END AS confidence "
        "FROM ex LEFT JOIN fz ON fz.name = ex.name LEFT JOIN vb ON vb.name = ex.name), "
        ""
    )


def _sub_chain() -> str:
    """CTEs from ``cat(name, lookup, category)`` (one category per name) to
    ``subs(name, sub, sub_conf, sub_source)``."""
    return (
        # sub-category chain
        "cands AS (SELECT lower(category) AS cat_key, name AS candidate, ord AS cand_ord FROM catalogue), "
        "cmap AS (SELECT cat_key, lower(candidate) AS lc, arg_max(candidate, cand_ord) AS canon FROM cands GROUP BY 1, 2), "
        "sp AS (SELECT cat.*, lower(category) AS cat_key FROM (SELECT DISTINCT name, lookup, category FROM cat) cat WHERE lower(category) IN (SELECT cat_key FROM cands)), "
        "se AS (SELECT sp.*, coalesce(c1.canon, c2.canon) AS exact_sub FROM sp "
        "LEFT JOIN cmap c1 ON c1.cat_key = sp.cat_key AND c1.lc = lower(sp.name) "
        "LEFT JOIN cmap c2 ON c2.cat_key = sp.cat_key AND c2.lc = lower(sp.lookup)), "
        "spc AS (SELECT sp.name AS key, lower(sp.name) AS nl, c.candidate, lower(c.candidate) AS cl, c.cand_ord "
        "FROM sp JOIN cands c ON c.cat_key = sp.cat_key), "
        + keyword_sql("k_", "spc") + ", "
        "tpc AS (SELECT sp.name || chr(1) || c.candidate AS k, sp.name, c.candidate, c.cand_ord, "
        "lower(" + strip_generic("sp.lookup") + ") AS a, lower(" + strip_generic("c.candidate") + ") AS b "
        "FROM sp JOIN cands c ON c.cat_key = sp.cat_key), "
        + token_set_sql("tpc", "k", "a", "b", "ts") + ", "
        "sfz AS (SELECT tpc.name, arg_min({'c': tpc.candidate, 's': ts.tset / 100.0}, {'ns': -ts.tset, 'o': tpc.cand_ord}) AS x "
        "FROM tpc JOIN ts ON ts.key = tpc.k GROUP BY tpc.name), "
        "vqq AS (SELECT name AS qid, cat_key AS grp, lookup AS text FROM sp), "
        "vco AS (SELECT cat_key AS grp, CAST(cand_ord AS VARCHAR) AS did, cand_ord AS ord, candidate AS sub, "
        "candidate AS text FROM cands), "
        + refit_sql("v_", "vqq", "vco") + ", "
        "rel AS (SELECT lower(category) AS grp, name AS text, name AS sub, ord FROM catalogue), "
        "relg AS (SELECT grp FROM rel GROUP BY grp HAVING count(*) >= 2), "
        "dqq AS (SELECT name AS qid, cat_key AS grp, name AS text FROM sp WHERE cat_key IN (SELECT grp FROM relg)), "
        "dco AS (SELECT grp, CAST(ord AS VARCHAR) AS did, ord, sub, text FROM rel), "
        + refit_sql("d_", "dqq", "dco") + ", "
        "sub AS (SELECT se.name, "
        "CASE WHEN se.exact_sub IS NOT NULL THEN 'exact' WHEN kw.x IS NOT NULL THEN 'keyword' "
        "WHEN sfz.x.s >= 0.55 THEN 'fuzzy' WHEN vbest.x.s >= 0.55 THEN 'vector' WHEN dbest.x.s >= 0.55 THEN 'dataset_sim' "
        "ELSE 'fallback' END AS sub_source, "
        "CASE WHEN se.exact_sub IS NOT NULL THEN se.exact_sub WHEN kw.x IS NOT NULL THEN kw.x.c "
        "WHEN sfz.x.s >= 0.55 THEN sfz.x.c WHEN vbest.x.s >= 0.55 THEN vbest.x.c WHEN dbest.x.s >= 0.55 THEN dbest.x.c "
        "WHEN dbest.x IS NOT NULL THEN dbest.x.c ELSE sfz.x.c END AS sub, "
        "CASE WHEN se.exact_sub IS NOT NULL THEN 1.0 WHEN kw.x IS NOT NULL THEN 0.92 "
        "WHEN sfz.x.s >= 0.55 THEN sfz.x.s WHEN vbest.x.s >= 0.55 THEN vbest.x.s WHEN dbest.x.s >= 0.55 THEN dbest.x.s "
        "WHEN dbest.x IS NOT NULL THEN dbest.x.s ELSE sfz.x.s END AS sub_conf "
        "FROM se LEFT JOIN k_kw kw ON kw.key = se.name LEFT JOIN sfz ON sfz.name = se.name "
        "LEFT JOIN v_best vbest ON vbest.qid = se.name LEFT JOIN d_best dbest ON dbest.qid = se.name), "
        "subs AS (SELECT name, sub, sub_conf, sub_source FROM sub UNION ALL "
        "SELECT DISTINCT name, 'Unknown', 0.0, 'fallback' FROM cat WHERE lower(category) NOT IN (SELECT cat_key FROM cands)) "
    )


def tag_names_sql() -> str:
    """Both layer chains over the names with the catalogue label table
    (model and reviewer off): every layer computed for every distinct name,
    the first hit chosen by CASE."""
    return (
        "WITH RECURSIVE " + NAMES + ", " + CATALOGUE + ", "
        "u AS (SELECT DISTINCT " + strip("product_name") + " AS name FROM names), "
        + _category_chain() + _sub_chain() +
        "SELECT n.row_id, c.category, round(c.confidence, 6) AS confidence, c.source, "
        "s.sub AS predicted_sub_category, round(s.sub_conf, 6) AS sub_confidence, s.sub_source, "
        "c.source = 'fallback' AS low_confidence, "
        "CASE c.source WHEN 'dataset' THEN 'dataset_exact' WHEN 'keyword' THEN 'dataset_exact' "
        "WHEN 'fuzzy' THEN 'dataset_exact,fuzzy' WHEN 'vector' THEN 'dataset_exact,fuzzy,vector' "
        "ELSE 'dataset_exact,fuzzy,vector,ml,llm,fallback' END AS steps "
        "FROM names n JOIN cat c ON c.name = " + strip("n.product_name") + " JOIN subs s ON s.name = c.name"
    )


def _j6_ctes() -> str:
    """Distinct names ``us(name, ord, s, rk)`` and leader decisions
    ``ndn(name, ord, leader_ord, leader_name, score)`` (row-by-row loop)."""
    nm = strip("product_name")
    r = ratio("lcs.lcs", "pr.a", "pr.b")
    return (
        "uu AS (SELECT " + nm + " AS name, min(row_id) AS ord FROM names GROUP BY 1), "
        "us AS (SELECT name, ord, " + sort_tokens("name") + " AS s, row_number() OVER (ORDER BY ord) AS rk FROM uu), "
        "p0 AS (SELECT b.ord AS j, a.ord AS i, a.s AS sa, b.s AS sb FROM us a JOIN us b ON a.ord < b.ord "
        "AND 200.0 * least(length(a.s), length(b.s)) >= 92 * (length(a.s) + length(b.s))), "
        "pr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT sb AS a, sa AS b FROM p0)), "
        + lcs_cte("pr") + ", "
        "edges AS (SELECT p0.j, p0.i, " + r + " AS score FROM p0 "
        "JOIN pr ON pr.a = p0.sb AND pr.b = p0.sa JOIN lcs ON lcs.pid = pr.pid WHERE " + r + " >= 92), "
        "walk(k, lst) AS (SELECT 0, []::BIGINT[] UNION ALL "
        "SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.j = us.ord AND list_contains(w.lst, e.i)) "
        "THEN w.lst ELSE list_append(w.lst, us.ord) END FROM walk w JOIN us ON us.rk = w.k + 1), "
        "fin AS (SELECT lst FROM walk ORDER BY k DESC LIMIT 1), "
        "fol AS (SELECT e.j AS ord, arg_min({'i': e.i, 's': e.score}, {'ns': -e.score, 'i': e.i}) AS x FROM edges e, fin "
        "WHERE list_contains(fin.lst, e.i) AND NOT list_contains(fin.lst, e.j) GROUP BY e.j), "
        "ndn AS (SELECT us.name, us.ord, fol.x.i AS leader_ord, l.name AS leader_name, fol.x.s AS score FROM us "
        "LEFT JOIN fol ON fol.ord = us.ord LEFT JOIN us l ON l.ord = fol.x.i)"
    )


def batch_tag_sql() -> str:
    """in-batch reuse, leaders through both chains, followers copy their
    leader's category and confidence, D5 output with the review flag."""
    return (
        "WITH RECURSIVE " + NAMES + ", " + CATALOGUE + ", " + _j6_ctes() + ", "
        "rws AS (SELECT n.row_id, " + strip("n.product_name") + " AS name, p.p_brand AS brand FROM names n "
        "JOIN part p ON p.p_partkey = n.row_id), "
        "rr AS (SELECT rws.*, CASE WHEN ndn.leader_name IS NULL AND rws.row_id = ndn.ord THEN NULL "
        "ELSE coalesce(ndn.leader_name, rws.name) END AS reuse_from FROM rws JOIN ndn ON ndn.name = rws.name), "
        "u AS (SELECT DISTINCT name FROM rr WHERE reuse_from IS NULL), "
        + _category_chain().replace("cat AS (SELECT ex.name", "catl AS (SELECT ex.name") +
        "fl AS (SELECT DISTINCT name, reuse_from FROM rr WHERE reuse_from IS NOT NULL), "
        "catf AS (SELECT fl.name, " + clean("fl.name") + " AS lookup, 'batch_cache' AS source, c.category, c.confidence "
        "FROM fl JOIN catl c ON c.name = fl.reuse_from), "
        "cat AS (SELECT name, lookup, source, category, confidence FROM catl UNION ALL "
        "SELECT name, lookup, source, category, confidence FROM catf), "
        + _sub_chain() +
        ", res AS (SELECT rr.row_id, rr.brand, rr.name, coalesce(c.category, f.category) AS category, "
        "coalesce(c.confidence, f.confidence) AS confidence, coalesce(c.source, f.source) AS source FROM rr "
        "LEFT JOIN catl c ON rr.reuse_from IS NULL AND c.name = rr.name "
        "LEFT JOIN catf f ON rr.reuse_from IS NOT NULL AND f.name = rr.name) "
        "SELECT res.row_id, coalesce(res.brand, '') AS brand, res.name AS product_name, res.category AS predicted_category, "
        "s.sub AS predicted_sub_category, round(res.confidence, 4) AS category_confidence, "
        "round(s.sub_conf, 4) AS sub_category_confidence, res.source AS category_source, "
        "s.sub_source AS sub_category_source, CASE WHEN res.confidence < 0.75 OR s.sub_conf < 0.5 "
        "OR res.source IN ('llm', 'fallback', 'batch_cache') THEN 'YES' ELSE 'NO' END AS needs_review "
        "FROM res JOIN subs s ON s.name = res.name"
    )


def near_dup_sql() -> str:
    """J6 as the row-by-row loop: all earlier pairs passing a necessary
    length test, SQL LCS, then a recursive walk over names in first-appearance
    order that keeps the leader list."""
    nm = strip("product_name")
    r = ratio("lcs.lcs", "pr.a", "pr.b")
    return (
        "WITH RECURSIVE " + NAMES + ", "
        "u AS (SELECT " + nm + " AS name, min(row_id) AS ord FROM names GROUP BY 1), "
        "us AS (SELECT name, ord, " + sort_tokens("name") + " AS s, row_number() OVER (ORDER BY ord) AS rk FROM u), "
        "p0 AS (SELECT b.ord AS j, a.ord AS i, a.s AS sa, b.s AS sb FROM us a JOIN us b ON a.ord < b.ord "
        "AND 200.0 * least(length(a.s), length(b.s)) >= 92 * (length(a.s) + length(b.s))), "
        "pr AS (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT sb AS a, sa AS b FROM p0)), "
        + lcs_cte("pr") + ", "
        "edges AS (SELECT p0.j, p0.i, " + r + " AS score FROM p0 "
        "JOIN pr ON pr.a = p0.sb AND pr.b = p0.sa JOIN lcs ON lcs.pid = pr.pid WHERE " + r + " >= 92), "
        "walk(k, lst) AS (SELECT 0, []::BIGINT[] UNION ALL "
        "SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.j = us.ord AND list_contains(w.lst, e.i)) "
        "THEN w.lst ELSE list_append(w.lst, us.ord) END FROM walk w JOIN us ON us.rk = w.k + 1), "
        "fin AS (SELECT lst FROM walk ORDER BY k DESC LIMIT 1), "
        "fol AS (SELECT e.j AS ord, arg_min({'i': e.i, 's': e.score}, {'ns': -e.score, 'i': e.i}) AS x FROM edges e, fin "
        "WHERE list_contains(fin.lst, e.i) AND NOT list_contains(fin.lst, e.j) GROUP BY e.j) "
        "SELECT us.ord, fol.x.i AS leader_ord, round(fol.x.s, 6) AS score FROM us LEFT JOIN fol ON fol.ord = us.ord"
    )


ORACLE_SQL = build()
ORACLE_SQL["tag_names"] = tag_names_sql()
ORACLE_SQL["near_dup_leaders"] = near_dup_sql()
ORACLE_SQL["batch_tag"] = batch_tag_sql()
ORACLE_SQL["stream_tag"] = ("WITH b AS (" + batch_tag_sql() + ") SELECT row_id, predicted_category, "
                            "predicted_sub_category, category_source, needs_review FROM b")
ORACLE_SQL["cv_folds"] = (
    "WITH " + NAMES + ", "
    "u AS (SELECT " + strip("product_name") + " AS name, min(row_id) AS ord FROM names GROUP BY 1), "
    "t AS (SELECT ord AS rid, " + hint("name") + " AS label, ord FROM u), "
    "t2 AS (SELECT * FROM t WHERE label IS NOT NULL), "
    "cls AS (SELECT label, min(ord) AS first, count(*) AS n FROM t2 GROUP BY label), "
    "kk AS (SELECT least(5, min(n)) AS k FROM cls), "
    "cs AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls), "
    # every position of the class-ordered list, its class and p mod k
    "pos AS (SELECT cs.label, p, p % (SELECT k FROM kk) AS f FROM cs, "
    "LATERAL (SELECT unnest(generate_series(cs.s::BIGINT, (cs.s + cs.n - 1)::BIGINT)) AS p)), "
    "alloc AS (SELECT label, f, count(*) AS a FROM pos GROUP BY 1, 2), "
    "cum AS (SELECT label, f, sum(a) OVER (PARTITION BY label ORDER BY f) AS c FROM alloc), "
    "rk AS (SELECT rid, label, row_number() OVER (PARTITION BY label ORDER BY ord) - 1 AS r FROM t2) "
    "SELECT rk.rid, rk.label, min(cum.f)::INTEGER AS fold FROM rk JOIN cum ON cum.label = rk.label AND cum.c > rk.r "
    "GROUP BY rk.rid, rk.label")
ORACLE_SQL["model_train"] = (
    "WITH " + LB + ", " + W2 + " SELECT 'trained' AS status, count(*) AS samples, "
    "(SELECT string_agg(category, ',' ORDER BY category) FROM (SELECT DISTINCT category FROM w2)) AS classes FROM w2")
ORACLE_SQL["bootstrap_retrain"] = (
    "WITH " + CATALOGUE + " SELECT 'trained' AS status, count(*) AS samples, count(*) AS seeded, "
    "count(DISTINCT category)::INTEGER AS n_classes FROM catalogue")
ORACLE_SQL["correct_retrain"] = (
    "WITH " + NAMES + ", " + CATALOGUE + ", "
    "c AS (SELECT DISTINCT lower(" + strip("n.product_name") + ") AS k FROM names n JOIN labels l ON l.doc_id = n.row_id) "
    "SELECT 'trained' AS status, (SELECT count(*) FROM catalogue) + "
    "(SELECT count(*) FROM c WHERE k NOT IN (SELECT lower(name) FROM catalogue)) AS samples, "
    "true AS correction_applied")
ORACLE_SQL["review_counts"] = ("WITH b AS (" + batch_tag_sql().replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ") "
                               "SELECT needs_review, category_source, count(*) AS n FROM b GROUP BY 1, 2")
ORACLE_SQL["full_chain"] = (
    "SELECT row_id, source <> 'fallback' AS early, true AS ml_is_confident, true AS fallback_is_weak, true AS llm_flag, "
    "true AS steps_ok, true AS has_sub FROM (" + tag_names_sql() + ")")
