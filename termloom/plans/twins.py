"""DuckDB SQL of the registered queries, from common table expressions."""

from __future__ import annotations

_TOKENS = r"unnest(regexp_extract_all(lower(text), '\p{L}{2,}'))"

#: Parts by name; each may use the ones it lists.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "s": ((), "SELECT doc_id AS sample_id, text AS content FROM documents"),
    "tok": ((), f"SELECT doc_id AS sample_id, {_TOKENS} AS term FROM documents"),
    "tf": (("tok",), "SELECT sample_id, term, count(*) AS n FROM tok GROUP BY 1, 2"),
    "btok": ((), f"SELECT item_id AS sample_id, {_TOKENS} AS term FROM benchmark"),
    "btf": (("btok",), "SELECT sample_id, term, count(*) AS n FROM btok GROUP BY 1, 2"),
    "dim": (("s", "tf"), "SELECT s.sample_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS sample_terms, count(term) AS distinct_terms FROM s LEFT JOIN tf USING (sample_id) GROUP BY 1"),
    "st": (("tf",), "SELECT term, CAST(sum(n) AS BIGINT) AS term_used, count(*) AS term_samples FROM tf GROUP BY 1"),
    "va": (("st",), "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM st"),
    "vb": (("btf",), "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM btf)"),
    "new": (("va", "vb"), "SELECT term, term_id AS from_id, (SELECT max(term_id) + 1 FROM va) + row_number() OVER (ORDER BY term) - 1 AS to_id FROM vb WHERE term NOT IN (SELECT term FROM va)"),
    "cat": ((), "SELECT doc_id AS sample_id, trim(lang) AS cat1, trim(source) AS cat2, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS cat3 FROM documents"),
    "c1": (("cat",), "SELECT cat1, 1000000 * row_number() OVER (ORDER BY cat1) AS id1 FROM (SELECT DISTINCT cat1 FROM cat)"),
    "c2": (("c1",), "SELECT cat1, cat2, id1 + 1000 * row_number() OVER (ORDER BY cat1, cat2) AS id2 FROM (SELECT DISTINCT cat1, cat2 FROM cat) JOIN c1 USING (cat1)"),
    "c3": (("c2",), "SELECT cat1, cat2, cat3, id2 + row_number() OVER (ORDER BY cat1, cat2, cat3) AS id3 FROM (SELECT DISTINCT cat1, cat2, cat3 FROM cat) JOIN c2 USING (cat1, cat2)"),
    "tree": (("c1", "c2", "c3"), "SELECT CAST(id1 AS BIGINT) AS category_id, 1 AS level, cat1, '' AS cat2, '' AS cat3 FROM c1 UNION ALL SELECT id2, 2, cat1, cat2, '' FROM c2 UNION ALL SELECT id3, 3, cat1, cat2, cat3 FROM c3"),
    "own": (("c3",), "SELECT sample_id, CAST(id3 AS BIGINT) AS category_id FROM cat JOIN c3 USING (cat1, cat2, cat3)"),
    "w": (("tf", "dim", "st"), "SELECT sample_id, term, n / sample_terms * ln((SELECT CAST(count(*) AS DOUBLE) FROM dim) / term_samples) AS weight FROM tf JOIN st USING (term) JOIN dim USING (sample_id)"),
    "pos": ((), "SELECT DISTINCT doc_id AS sample_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)"),
    "unl": (("s", "pos"), "SELECT sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM pos)"),
    "up": (("tf", "pos"), "SELECT term, CAST(sum(n) AS DOUBLE) AS x FROM tf WHERE sample_id IN (SELECT sample_id FROM pos) GROUP BY 1"),
    "uu": (("tf", "pos"), "SELECT term, CAST(sum(n) AS DOUBLE) AS x FROM tf WHERE sample_id NOT IN (SELECT sample_id FROM pos) GROUP BY 1"),
    "spec": (("up", "uu"), "SELECT up.term, (up.x / (SELECT sum(x) FROM up)) / (up.x / (SELECT sum(x) FROM up) + coalesce(uu.x / (SELECT sum(x) FROM uu), 0)) AS speciality FROM up LEFT JOIN uu USING (term)"),
    "r": (("tf", "dim", "pos"), "SELECT term, n / sample_terms AS r FROM tf JOIN dim USING (sample_id) WHERE sample_id IN (SELECT sample_id FROM pos)"),
    "pop": (("r",), "SELECT term, greatest((ln(sum(r)) - sum(r * ln(r)) / sum(r)) / ln((SELECT count(*) FROM pos)), 0) AS popularity FROM r GROUP BY 1"),
    "pd": (("spec", "pop"), "SELECT term, speciality * popularity AS degree, speciality, popularity FROM spec JOIN pop USING (term)"),
    "mem": (("own",), "SELECT sample_id, CAST(floor(category_id / 1000000.0) * 1000000 AS BIGINT) AS category FROM own"),
    "cat0": (("tf", "mem", "dim"), "SELECT category, term, CAST(sum(n) AS DOUBLE) AS used, sum(n / sample_terms) AS s, sum(n / sample_terms * ln(n / sample_terms)) AS v FROM tf JOIN mem USING (sample_id) JOIN dim USING (sample_id) GROUP BY 1, 2"),
    "cpd0": (
        ("cat0", "st"),
        "SELECT category, term, used / total AS p, coalesce((term_used - used) / nullif((SELECT sum(n) FROM tf) - total, 0), 0) AS u, CASE WHEN docs > 1 THEN greatest((ln(s) - v / s) / ln(docs), 0) ELSE 0 END AS popularity "
        "FROM cat0 JOIN (SELECT category, sum(used) AS total FROM cat0 GROUP BY 1) USING (category) JOIN (SELECT category, CAST(count(*) AS DOUBLE) AS docs FROM mem GROUP BY 1) USING (category) JOIN st USING (term)",
    ),
    "cpd": (("cpd0",), "SELECT category, term, p / (p + u) AS speciality, popularity FROM cpd0"),
    "kw": (("pd",), "SELECT term, speciality + popularity AS degree FROM pd WHERE round(speciality + popularity, 9) >= 0.4 AND round(speciality, 9) >= 0.8 AND round(popularity, 9) >= 0.01"),
    "pus": (
        ("dim", "kw", "unl"),
        "SELECT sample_id, CASE WHEN sample_terms > 1 THEN coalesce(v, 0) / ln(sample_terms) ELSE 0 END AS score FROM dim JOIN unl USING (sample_id) LEFT JOIN (SELECT sample_id, sum(degree) AS v FROM (SELECT sample_id, degree, row_number() OVER (PARTITION BY sample_id ORDER BY degree, term) AS k FROM tf JOIN kw USING (term)) WHERE k <= 20 GROUP BY 1) USING (sample_id)",
    ),
    "resp": (("s", "pos"), "SELECT sample_id, c, CASE WHEN (sample_id IN (SELECT sample_id FROM pos)) = (c = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pr FROM s, (VALUES (1), (-1)) k(c)"),
    "pc": (("resp",), "SELECT c, sum(pr) / count(*) AS pr_c FROM resp GROUP BY 1"),
    "lik0": (("tf", "resp"), "SELECT term, c, sum(n * pr) AS s FROM tf JOIN resp USING (sample_id) GROUP BY 1, 2"),
    "lik": (("lik0",), "SELECT term, c, (1 + s) / (v + a) AS pr_f FROM lik0 JOIN (SELECT c, sum(s) AS a, count(*) AS v FROM lik0 GROUP BY 1) USING (c)"),
    "lg": (("tf", "lik"), "SELECT sample_id, sum(ln(pr_f)) FILTER (c = 1) AS lp, sum(ln(pr_f)) FILTER (c = -1) AS lm FROM tf JOIN lik USING (term) GROUP BY 1"),
    "ab": (("s", "lg", "pc"), "SELECT sample_id, coalesce(lp, 0) + ln((SELECT pr_c FROM pc WHERE c = 1)) AS a, coalesce(lm, 0) + ln((SELECT pr_c FROM pc WHERE c = -1)) AS b FROM s LEFT JOIN lg USING (sample_id)"),
    "post": (("ab",), "SELECT sample_id, 1 / (1 + exp(least(greatest(b - a, -700), 700))) AS p_pos, 1 / (1 + exp(-least(greatest(b - a, -700), 700))) AS p_neg, CASE WHEN a >= b THEN 1 ELSE -1 END AS predicted, CASE WHEN sample_id IN (SELECT sample_id FROM pos) THEN 1 ELSE -1 END AS target FROM ab"),
    "conf": (("post", "pos"), "SELECT count(*) FILTER (target = 1 AND predicted = 1) AS tp, count(*) FILTER (target = 1 AND predicted = -1) AS fp, count(*) FILTER (target = -1 AND predicted = 1) AS tn, count(*) FILTER (target = -1 AND predicted = -1) AS fn FROM post"),
    "pg": ((), "SELECT page_id AS sample_id, url, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '' ELSE html END AS content, 'c' || (page_id % 5) AS cat1, 's' || (page_id % 3) AS cat2 FROM pages"),
    "ev": ((), "SELECT 'event/' || event_id AS url, CAST(floor(epoch(ts)) AS BIGINT) AS publish_time, CASE WHEN event_id % 4 <> 0 THEN event_type END AS title, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS text, ts FROM events"),
    # spies: every tenth of the positives by md5, one EM round
    "spy": (("pos",), "SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS k FROM pos) WHERE k <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM pos)"),
    "yresp": (("s", "pos", "spy"), "SELECT sample_id, c, CASE WHEN (sample_id IN (SELECT sample_id FROM pos) AND sample_id NOT IN (SELECT sample_id FROM spy)) = (c = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pr FROM s, (VALUES (1), (-1)) k(c)"),
    "ypc": (("yresp",), "SELECT c, sum(pr) / count(*) AS pr_c FROM yresp GROUP BY 1"),
    "ylik0": (("tf", "yresp"), "SELECT term, c, sum(n * pr) AS s FROM tf JOIN yresp USING (sample_id) GROUP BY 1, 2"),
    "ylik": (("ylik0",), "SELECT term, c, (1 + s) / (v + a) AS pr_f FROM ylik0 JOIN (SELECT c, sum(s) AS a, count(*) AS v FROM ylik0 GROUP BY 1) USING (c)"),
    "ylg": (("tf", "ylik"), "SELECT sample_id, sum(ln(pr_f)) FILTER (c = 1) AS lp, sum(ln(pr_f)) FILTER (c = -1) AS lm FROM tf JOIN ylik USING (term) GROUP BY 1"),
    "ypost": (("s", "ylg", "ypc"), "SELECT sample_id, 1 / (1 + exp(least(greatest(coalesce(lm, 0) + ln((SELECT pr_c FROM ypc WHERE c = -1)) - coalesce(lp, 0) - ln((SELECT pr_c FROM ypc WHERE c = 1)), -700), 700))) AS p_pos FROM s LEFT JOIN ylg USING (sample_id)"),
    "yt": (("ypost", "spy"), "SELECT p_pos AS t FROM (SELECT p_pos, row_number() OVER (ORDER BY p_pos, sample_id) - 1 AS k FROM ypost WHERE sample_id IN (SELECT sample_id FROM spy)) WHERE k = (SELECT CAST(floor(count(*) * 0.15) AS BIGINT) FROM spy)"),
    "split": (("ypost", "yt", "pos"), "SELECT sample_id, p_pos, p_pos < (SELECT t FROM yt) AS reliable FROM ypost WHERE sample_id NOT IN (SELECT sample_id FROM pos)"),
}


def _em(name: str, positives: str, fixed: str, mixed: str, rounds: int = 12) -> None:
    """Parts ``name`` (sample_id, p_pos, p_neg, predicted): EM from positives at
    1 and ``mixed`` at 0 (``fixed``: at 0 throughout, too), unrolled; of its rounds
    that one counts which is the first to predict as the one before it."""
    at = lambda k: f"{name}_{k}"
    held = f"SELECT sample_id, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM {positives}" + (f" UNION ALL SELECT sample_id, 0.0::DOUBLE, 1.0::DOUBLE FROM {fixed}" if fixed else "")
    start = held if fixed else f"{held} UNION ALL SELECT sample_id, 0.0::DOUBLE, 1.0::DOUBLE FROM {mixed}"
    needs = (positives, mixed) + ((fixed,) if fixed else ())
    _PARTS[at("e0")] = (needs, start)
    for k in range(1, rounds + 1):
        e = at(f"e{k - 1}")
        _PARTS[at(f"l{k}")] = (("tf", e), f"SELECT term, sum(n * p) AS a, sum(n * q) AS b FROM tf JOIN {e} USING (sample_id) GROUP BY 1")
        _PARTS[at(f"t{k}")] = ((at(f"l{k}"),), f"SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM {at(f'l{k}')}")
        _PARTS[at(f"x{k}")] = (
            ("tf", mixed, e, at(f"l{k}"), at(f"t{k}")),
            f"SELECT m.sample_id, coalesce(lp, 0) + ln((SELECT sum(p) / count(*) FROM {e})) AS a, coalesce(lq, 0) + ln((SELECT sum(q) / count(*) FROM {e})) AS b FROM {mixed} m "
            f"LEFT JOIN (SELECT sample_id, sum(ln((1 + a) / (v + sa))) AS lp, sum(ln((1 + b) / (v + sb))) AS lq FROM tf JOIN {at(f'l{k}')} USING (term) CROSS JOIN {at(f't{k}')} GROUP BY 1) USING (sample_id)",
        )
        _PARTS[at(f"p{k}")] = ((at(f"x{k}"),), f"SELECT {k} AS round, sample_id, 1 / (1 + exp(least(greatest(b - a, -700), 700))) AS p_pos, 1 / (1 + exp(-least(greatest(b - a, -700), 700))) AS p_neg, CASE WHEN a >= b THEN 1 ELSE -1 END AS predicted FROM {at(f'x{k}')}")
        _PARTS[at(f"e{k}")] = ((*needs, at(f"p{k}")), f"{held} UNION ALL SELECT sample_id, p_pos, p_neg FROM {at(f'p{k}')}")
    every = " UNION ALL ".join(f"SELECT * FROM {at(f'p{k}')}" for k in range(1, rounds + 1))
    _PARTS[at("all")] = (tuple(at(f"p{k}") for k in range(1, rounds + 1)), every)
    _PARTS[at("end")] = ((at("all"),), f"SELECT min(round) AS round FROM (SELECT b.round FROM {at('all')} a JOIN {at('all')} b ON a.sample_id = b.sample_id AND a.round + 1 = b.round GROUP BY 1 HAVING bool_and(a.predicted = b.predicted))")
    _PARTS[name] = ((at("all"), at("end")), f"SELECT sample_id, p_pos, p_neg, predicted FROM {at('all')} JOIN {at('end')} USING (round)")


_PARTS["rel"] = (("split",), "SELECT sample_id FROM split WHERE reliable")
_PARTS["unk"] = (("split",), "SELECT sample_id FROM split WHERE NOT reliable")
_PARTS["fold"] = (("pos",), "SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) <= floor((SELECT count(*) FROM pos) * 0.8::DOUBLE) AS known FROM pos")
_PARTS["fpos"] = (("fold",), "SELECT sample_id FROM fold WHERE known")
_PARTS["fmix"] = (("fold", "unl"), "SELECT sample_id FROM fold WHERE NOT known UNION ALL SELECT sample_id FROM unl")
_em("em", "pos", "", "unl")
_em("em2", "pos", "rel", "unk")
_em("iem", "fpos", "", "fmix")
_PARTS["iconf"] = (("iem", "fold"), "SELECT count(*) FILTER (target = 1 AND predicted = 1) AS tp, count(*) FILTER (target = 1 AND predicted = -1) AS fp, count(*) FILTER (target = -1 AND predicted = 1) AS tn, count(*) FILTER (target = -1 AND predicted = -1) AS fn FROM (SELECT predicted, CASE WHEN sample_id IN (SELECT sample_id FROM fold) THEN 1 ELSE -1 END AS target FROM iem)")


def _with(body: str, *parts: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for p in _PARTS[name][0]:
            add(p)
        order.append(name)

    for p in parts:
        add(p)
    return ("WITH " + ",\n".join(f"{p} AS MATERIALIZED ({_PARTS[p][1]})" for p in order) + "\n" if order else "") + body


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_ZERO = "coalesce({0} / nullif({1}, 0), 0)"


def _report(counts: str) -> str:
    """Precision, recall and F1 of both classes from a part of counts."""
    return _with(
        f", q AS (SELECT *, {_ZERO.format('tp', '(tp + tn)')} AS a, {_ZERO.format('tp', '(tp + fp)')} AS b, {_ZERO.format('fn', '(fn + fp)')} AS c, {_ZERO.format('fn', '(fn + tn)')} AS d FROM {counts}) SELECT tp, fp, tn, fn, round(a, 6) AS p_precision, round(b, 6) AS p_recall, round(c, 6) AS n_precision, round(d, 6) AS n_recall, round({_ZERO.format('2 * a * b', '(a + b)')}, 6) AS p_f1, round({_ZERO.format('2 * c * d', '(c + d)')}, 6) AS n_f1 FROM q",
        counts,
    ).replace("\n, q AS", ",\nq AS")


TWINS: dict[str, str] = {
    "tf_counts": _with("SELECT sample_id, term, n FROM tf", "tf"),
    "term_stats": _with("SELECT * FROM st", "st"),
    "total_terms": _with("SELECT CAST(sum(term_used) AS BIGINT) AS total_terms_used, (SELECT count(*) FROM s) AS total_samples, count(*) AS total_terms FROM st", "st", "s"),
    "char_ngrams4": "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS samples FROM (SELECT doc_id, unnest(list_transform(range(1, least(length(text) - 3, 3001) + 1), lambda i: substring(text, i, 4))) AS term FROM documents) GROUP BY 1",
    "doc_lengths": _with("SELECT * FROM dim", "dim"),
    "document_frequency": _with("SELECT term, count(DISTINCT sample_id) AS df FROM tok GROUP BY 1", "tok"),
    "term_category_matrix": _with(
        """, cell AS (SELECT term, CAST(floor(category_id / 1000.0) * 1000 AS BIGINT) AS category_2, sum(weight) AS weight, CAST(sum(n) AS BIGINT) AS n
           FROM tf JOIN w USING (sample_id, term) JOIN own USING (sample_id) WHERE term IN (SELECT term FROM st WHERE term_used >= 50) GROUP BY 1, 2),
        rt AS (SELECT *, weight / nullif(sum(weight) OVER (PARTITION BY term), 0) AS ratio FROM cell),
        k AS (SELECT CAST(count(DISTINCT floor(category_id / 1000.0)) AS DOUBLE) AS k FROM own),
        sd AS (SELECT term, sqrt(sum(pow(ratio - m, 2) / k)) AS sd FROM (SELECT term, ratio, k, sum(ratio) OVER (PARTITION BY term) / k AS m FROM rt, k) GROUP BY 1)
        SELECT term, category_2, n, round(weight, 6) AS weight, round(ratio, 6) AS ratio, round(sd, 6) AS sd FROM rt JOIN sd USING (term)""",
        "tf", "w", "own", "st",
    ).replace("\n, cell", ",\ncell"),
    "top_terms_per_doc": _with("SELECT sample_id, term, n, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, term) AS INTEGER) AS rank FROM tf WHERE n > 1", "tf"),
    "flagship_tfidf_top10": _with("SELECT sample_id, term, round(weight, 6) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM w) WHERE rank <= 10", "w"),
    "vocab_ids": _with("SELECT term, term_id FROM va", "va"),
    "vocab_diff": _with("SELECT vb.term, vb.term_id AS from_id, va.term_id AS to_id FROM vb JOIN va USING (term) UNION ALL SELECT * FROM new", "new"),
    "vocab_merge": _with("SELECT * FROM va UNION ALL SELECT term, to_id FROM new", "new"),
    "vocab_transform": _with("SELECT sample_id, count(*) AS length, count(DISTINCT term_id) AS terms, CAST(sum(term_id) AS BIGINT) AS id_sum FROM btok JOIN va USING (term) GROUP BY 1", "va", "btok"),
    "vocab_lookup": _with("SELECT vb.term, coalesce(va.term_id, -1) AS term_id FROM vb LEFT JOIN va USING (term)", "va", "vb"),
    "category_ids": _with("SELECT * FROM tree", "tree"),
    "category_rollup": _with("SELECT sample_id, id AS category_id, CAST(floor(id / 1000000.0) * 1000000 AS BIGINT) AS level_1, CAST(floor(id / 1000.0) * 1000 AS BIGINT) AS level_2 FROM (SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN -1 ELSE category_id END AS id FROM own)", "own"),
    "category_usage": _with("SELECT coalesce(t.category_id, u.category_id) AS category_id, coalesce(samples, 0) AS samples, t.category_id IS NOT NULL AS known FROM tree t FULL JOIN (SELECT CASE WHEN sample_id % 10 = 0 THEN 77 ELSE category_id END AS category_id, count(*) AS samples FROM own GROUP BY 1) u USING (category_id)", "tree", "own"),
    "category_names": _with("SELECT sample_id, id AS category_id, coalesce(cat1, '') AS cat1, coalesce(cat2, '') AS cat2, coalesce(cat3, '') AS cat3 FROM (SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN -1 ELSE category_id END AS id FROM own) LEFT JOIN tree ON category_id = id", "own", "tree"),
    "category_remap": _with("SELECT sample_id, coalesce(n1, cat1) AS cat1, coalesce(n2, cat2) AS cat2, cat3 FROM cat LEFT JOIN (VALUES ('en', 'src0', 'english', 'zero'), ('fr', 'src1', 'french', 'one'), ('de', 'src2', 'en', 'src0')) m(a, b, n1, n2) ON a = cat1 AND b = cat2", "cat"),
    "category_report": _with("SELECT t.category_id AS ID, cat1 AS CAT1, cat2 AS CAT2, cat3 AS CAT3, count(sample_id) AS SAMPLES FROM tree t LEFT JOIN own USING (category_id) GROUP BY 1, 2, 3, 4", "tree", "own"),
    "category_cube": _with("SELECT cat1, cat2, cat3, count(*) AS samples FROM cat GROUP BY ROLLUP (cat1, cat2, cat3)", "cat"),
    "invalid_category_hist": _with("SELECT cat1, cat2, count(*) AS samples FROM pg WHERE cat1 NOT IN ('c0', 'c1') GROUP BY 1, 2", "pg"),
    "content_status": _with("SELECT CASE WHEN content IS NULL THEN 'null' WHEN content = '' THEN 'empty' ELSE 'normal' END AS status, count(*) AS samples FROM pg GROUP BY 1", "pg"),
    "purge": _with("SELECT sample_id, cat1, cat2 FROM pg WHERE length(content) > 0 AND cat1 IN ('c0', 'c1', 'c2')", "pg"),
    "url_report": _with("SELECT url, CASE WHEN content IS NULL THEN 'None' WHEN content = '' THEN 'Empty' ELSE 'Normal' END AS status, CASE WHEN content IS NULL THEN 0 WHEN content = '' THEN 1 ELSE 2 END AS place FROM pg WHERE length(url) > 0", "pg"),
    "sample_sheet": _with("SELECT cat1 AS CAT1, cat2 AS CAT2, 't' AS TITLE, 'k' AS KEY, url AS URL, md5(substring(repeat(coalesce(content, ''), 40), 1, 32767)) AS CONTENT_MD5, CAST(length(substring(repeat(coalesce(content, ''), 40), 1, 32767)) AS INTEGER) AS CONTENT_LENGTH FROM pg", "pg"),
    "spider_range": _with("SELECT url, publish_time, text FROM ev WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) AND text <> ''", "ev"),
    "spider_project": _with("SELECT url, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS publish_time, coalesce(title, '') AS title, text FROM ev", "ev"),
    "positional_subset": _with("SELECT sample_id, k - 100 AS new_id, 's' || sample_id AS label FROM (SELECT sample_id, row_number() OVER (ORDER BY CAST(sample_id AS VARCHAR)) - 1 AS k FROM s) WHERE k BETWEEN 100 AND 349", "s"),
    "hash_sample_k": _with("SELECT sample_id FROM s ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id LIMIT 137", "s"),
    "ratio_split": _with("SELECT sample_id, CASE WHEN k <= floor((SELECT count(*) FROM s) * 0.3 + 0.5) THEN 1 ELSE 2 END AS part FROM (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS k FROM s)", "s"),
    "cv_split": _with(
        "SELECT sample_id, CASE WHEN k < a THEN 'p' WHEN k < a + CAST(floor((n - a) * 0.5) AS BIGINT) THEN 'hidden' ELSE 'out' END AS fold FROM (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1 AS k, (SELECT count(*) FROM pos) AS n, CAST(floor((SELECT count(*) FROM pos) * 0.8) AS BIGINT) AS a FROM pos) UNION ALL SELECT sample_id, 'u' FROM unl",
        "unl",
    ),
    "by_category_1": _with("SELECT sample_id, category_id, floor(category_id / 1000000.0) = 2 AS is_positive FROM own", "own"),
    "by_category_2": _with("SELECT sample_id, id AS category_id, id = 2025000 AS is_positive FROM (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN CAST(floor(category_id / 1000.0) * 1000 AS BIGINT) ELSE category_id END AS id FROM own) WHERE floor(id / 1000000.0) = 2", "own"),
    "select_terms_keep_length": _with("SELECT sample_id, term, n, sample_terms FROM tf JOIN dim USING (sample_id) WHERE term IN (SELECT term FROM st WHERE term_used >= 50)", "dim", "st"),
    "clone_subset": _with("SELECT term, CAST(sum(n) AS BIGINT) AS term_used, count(*) AS term_samples FROM tf WHERE sample_id IN (SELECT sample_id FROM pos) AND term IN (SELECT term FROM st WHERE term_samples >= 5) GROUP BY 1", "st", "pos"),
    "merge_samples": _with("SELECT term, CAST(sum(n) AS BIGINT) AS term_used, count(*) AS term_samples FROM (SELECT * FROM tf WHERE sample_id NOT IN (SELECT sample_id FROM btf) UNION ALL SELECT * FROM btf) GROUP BY 1", "tf", "btf"),
    "append_samples": "SELECT sample_id, label, row_number() OVER (ORDER BY part, CAST(sample_id AS VARCHAR)) - 1 AS new_id FROM (SELECT 1 AS part, doc_id AS sample_id, 'd' || doc_id AS label FROM documents UNION ALL SELECT 2, item_id, 'b' || item_id FROM benchmark)",
    "set_difference": _with("SELECT term FROM tf EXCEPT SELECT term FROM btf", "tf", "btf"),
    "set_intersection": _with("SELECT term FROM tf INTERSECT SELECT term FROM btf", "tf", "btf"),
    "tfidf_py": _with("SELECT sample_id, term, round(weight, 6) AS weight FROM w", "w"),
    "tfidf_cpp": _with("SELECT sample_id, term, round(x / (sqrt(sum(x * x) OVER ())), 6) AS weight FROM (SELECT sample_id, term, n / sample_terms * ln((SELECT CAST(count(*) AS DOUBLE) FROM dim) / term_samples + 0.01) AS x FROM tf JOIN st USING (term) JOIN dim USING (sample_id))", "dim", "st"),
    "tfrf": _with("SELECT sample_id, term, round(n / sample_terms * rf, 6) AS weight FROM tf JOIN dim USING (sample_id) JOIN (SELECT term, CASE WHEN coalesce(uu.x, 0) <> 0 THEN ln(coalesce(up.x, 0) / uu.x + 3) ELSE ln(up.x + 2) END AS rf FROM up FULL JOIN uu USING (term)) USING (term)", "dim", "up", "uu"),
    "tfrf_given": _with("SELECT sample_id, term, round(term_samples / term_used, 6) AS weight FROM tf JOIN st USING (term) WHERE term_samples >= 20", "st"),
    "svm_lines": _with("SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN '1' ELSE '-1' END || ' ' || string_agg(term_id || ':' || printf('%.6f', weight), ' ' ORDER BY term_id) AS line FROM w JOIN va USING (term) GROUP BY sample_id", "w", "va"),
    "speciality": _with(f"SELECT term, {_r('speciality')} FROM pd", "pd"),
    "popularity": _with(f"SELECT term, {_r('popularity')} FROM pd", "pd"),
    "positive_degree": _with(f"SELECT term, {_r('degree', 'speciality', 'popularity')} FROM pd", "pd"),
    "pd_select": _with(f"SELECT term, {_r('degree', 'speciality', 'popularity')} FROM pd WHERE round(degree, 9) >= 0.4 AND round(speciality, 9) >= 0.8 AND round(popularity, 9) >= 0.01", "pd"),
    "pd_sum_form": _with("SELECT term, round(speciality + popularity, 6) AS degree, round(speciality, 6) AS speciality, round(popularity, 6) AS popularity FROM pd WHERE round(speciality + popularity, 9) >= 1 AND round(speciality, 9) >= 0.8 AND round(popularity, 9) >= 0.01", "pd"),
    "pd_sensitive": _with("SELECT term, round(coalesce(x, degree), 6) AS degree, round(CASE WHEN x IS NULL THEN speciality ELSE 1 END, 6) AS speciality, round(CASE WHEN x IS NULL THEN popularity ELSE 1 END, 6) AS popularity FROM pd LEFT JOIN (VALUES ('idiot', 3.0::DOUBLE), ('clown', 2.5::DOUBLE), ('the', 0.25::DOUBLE)) m(term, x) USING (term)", "pd"),
    "pd_by_category": _with("SELECT category, term, round(speciality * popularity, 6) AS degree, round(speciality, 6) AS speciality, round(popularity, 6) AS popularity FROM cpd WHERE round(popularity, 9) > 0.3", "cpd"),
    "category_weight_matrix": _with("SELECT sample_id, category, term, round(speciality + popularity, 6) AS weight FROM tf JOIN mem USING (sample_id) JOIN cpd USING (category, term) WHERE round(speciality + popularity, 9) >= 1 AND round(speciality, 9) >= 0.8 AND round(popularity, 9) >= 0.01", "cpd"),
    "pu_keyword_ranking": _with("SELECT sample_id, round(score, 6) AS score FROM pus", "pus"),
    "pu_svm_targets": _with("SELECT sample_id, 1 AS label FROM pos UNION ALL (SELECT sample_id, -1 FROM pus ORDER BY round(score, 6), sample_id LIMIT (SELECT count(*) FROM pos))", "pus"),
    "sample_positive_degree": _with(
        "SELECT sample_id, round(CASE WHEN sample_terms > 1 THEN coalesce(v, 0) / ln(sample_terms) ELSE 0 END, 6) AS score FROM dim LEFT JOIN (SELECT sample_id, sum(degree) AS v FROM (SELECT sample_id, round(degree, 6) AS degree, row_number() OVER (PARTITION BY sample_id ORDER BY round(degree, 6), term) AS k FROM tf JOIN pd USING (term) WHERE round(speciality, 9) >= 0.6) WHERE k <= 20 GROUP BY 1) USING (sample_id)",
        "dim", "pd",
    ),
    "sample_keyword_table": _with(f"SELECT term, n, {_r('degree', 'speciality', 'popularity')} FROM tf JOIN pd USING (term) WHERE sample_id = 28", "pd"),
    "keyword_extract": _with(
        """, i AS (SELECT term, ln((SELECT CAST(count(*) AS DOUBLE) FROM documents) / term_samples) AS idf FROM st WHERE term_samples >= 3)
        SELECT sample_id, term, round(x, 6) AS score, rank FROM (SELECT sample_id, term, x, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY round(x, 9) DESC, term) AS INTEGER) AS rank
        FROM (SELECT sample_id, tf.term, n * coalesce(idf, (SELECT avg(idf) FROM i)) AS x FROM tf LEFT JOIN i ON i.term = tf.term WHERE length(tf.term) > 1 AND tf.term NOT IN (SELECT term FROM st WHERE term_samples >= 200))) WHERE rank <= 5""",
        "st",
    ).replace("\n, i AS", ",\ni AS"),
    "nb_class_prior": _with("SELECT c, round(pr_c, 6) AS pr_c FROM pc", "pc"),
    "nb_feature_probs": _with("SELECT term, c, round(pr_f, 9) AS pr_f FROM lik", "lik"),
    "em_converged": _with(f"SELECT sample_id, predicted, {_r('p_pos', 'p_neg')} FROM em", "em"),
    "s_em_second_step": _with(f"SELECT sample_id, predicted, {_r('p_pos', 'p_neg')} FROM em2", "em2"),
    "nb_posterior": _with(f"SELECT sample_id, predicted, {_r('p_pos', 'p_neg')} FROM post", "post", "pos"),
    "confusion_matrix": _with("SELECT * FROM conf", "conf"),
    "prf_report": _report("conf"),
    "i_em_report": _report("iconf"),
    "class_report": _with(
        f", k AS (SELECT unnest([1, -1]) AS class), q AS (SELECT class, (SELECT count(*) FROM post WHERE target = class) AS support, (SELECT count(*) FROM post WHERE predicted = class) AS called, (SELECT count(*) FROM post WHERE predicted = class AND target = class) AS hit FROM k) SELECT class, support, round({_ZERO.format('hit', 'called')}, 6) AS precision, round({_ZERO.format('hit', 'support')}, 6) AS recall, round({_ZERO.format('2.0 * hit', '(support + called)')}, 6) AS f1 FROM q WHERE support + called > 0",
        "post", "pos",
    ).replace("\n, k AS", ",\nk AS"),
    "head_accuracy": _with("SELECT round(avg(CAST(target = predicted AS INTEGER)), 6) AS accuracy, round(avg(CAST(target = predicted AS INTEGER)) FILTER (sample_id < 100), 6) AS head_accuracy, round(coalesce(count(*) FILTER (predicted = 1 AND sample_id < 100) / nullif(count(*) FILTER (predicted = 1), 0), 0), 6) AS head_precision FROM post", "post", "pos"),
    "recall_at_k": _with("SELECT CAST(m AS INTEGER) AS multiple, round(count(*) FILTER (k <= 20 * m AND target = 1) / (SELECT count(*) FROM pos), 6) AS recall FROM (SELECT target, row_number() OVER (ORDER BY round(p_pos, 6) DESC, sample_id) AS k FROM post), (SELECT unnest([1, 2, 3]) AS m) GROUP BY m", "post", "pos"),
    "spy_threshold_split": _with(f"SELECT sample_id, {_r('p_pos')}, reliable FROM split", "split"),
    "sem_report": _with(
        f", j AS (SELECT reliable, CASE WHEN sample_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1 ELSE -1 END AS target FROM split), q AS (SELECT count(*) FILTER (reliable AND target = -1) AS tn, count(*) FILTER (reliable AND target = 1) AS tp, count(*) FILTER (NOT reliable AND target = 1) AS fp, count(*) FILTER (NOT reliable AND target = -1) AS fn FROM j) SELECT *, round({_ZERO.format('tn', '(tn + tp)')}, 6) AS accuracy, round({_ZERO.format('tn', '(tn + fp)')}, 6) AS accuracy_table FROM q",
        "split",
    ).replace("\n, j AS", ",\nj AS"),
    "hamming_within": "SELECT o_orderkey, o_custkey FROM orders WHERE bit_count(xor(o_orderkey, o_custkey)) <= 3",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "prediction_lines": _with("SELECT sample_id, '[' || sample_id || ']  - ' || predicted || ' - Score: ' || printf('%.6f', round(p_pos, 6)) || ' t' AS line FROM post", "post", "pos"),
    "ordered_positions": "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS place FROM customer",
}
