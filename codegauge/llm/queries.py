"""The queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn, license_scan, line_dedup, merkle, minhash_dedup, packing, periodic_runs, quality_rules, simhash_dedup, source_mix, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver found it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", knn.whole_components("embedding").alias("v"))
    return knn.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.dedup_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 with observed redirects: every third page leads to the next page's URL, and every fifth to that two further on."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    to = F.explode(F.array(F.when(F.col("page_id") % 3 == 0, F.col("page_id") + 1), F.when(F.col("page_id") % 5 == 0, F.col("page_id") + 2)))
    hops = pages.select(F.col("url").alias("source_url"), to.alias("to")).join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("target_url")), "to")
    return url_filter.judge(pages, redirects=hops.select("source_url", "target_url")).select("page_id", "rule", "verdict", "via")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_repeats(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")), whole=True)
    return kept.select("doc_id", "text", "n_lines", (F.col("n_lines") - F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))).alias("n_removed"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    got = license_scan.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return got.select(F.col("file_id").alias("doc_id"), "license", F.round("cosine", 6).alias("cosine"), F.col("source").alias("found"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.verified(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup_groups(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = docs.withColumns({"g": F.expr("h div 10"), "w": F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")}).withColumn("n", F.size("w"))
    # A text without words has no remainder; Spark may ask for it before it knows that the text stays as it is.
    words = words.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("w", (1 + F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text"))
    got = periodic_runs.collapsed(words.select("doc_id", text.alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    start, length, period = -top["start"], top["length"], -top["period"]
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_voronoi_knn, op2_source_mix, op3_simhash_dedup, op4_quality_rules, op5_url_filter, url_redirects, op6_line_dedup, op7_toxicity, op8_token_files, op9_packing, op10_license_scan, op11_merkle_manifest, op12_minhash_dedup, op13_periodic_runs)}


_WORD = r"[^\x20\x09-\x0D]+"


def _sql1() -> str:
    return """with e as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
        select query_id, rank::int as rank, vec_id, score from (select q.vec_id as query_id, e.vec_id, list_dot_product(q.v, e.v)::bigint as score,
        row_number() over (partition by q.vec_id order by list_dot_product(q.v, e.v) desc, e.vec_id) as rank from e q join e on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id) where rank <= 10"""


def _sql4() -> str:
    return f"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from d, unnest(range(1, len(w) - 6)) as t(i) where len(w) >= 8),
        rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
        cov as (select doc_id, count(distinct i + k) as n_repeat_words from rep, unnest(range(0, 8)) as u(k) group by doc_id),
        lin as (select doc_id, count(*) as lines, count(*) - count(distinct l) as dups from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '{_WORD}') group by doc_id),
        s as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
            coalesce(dups, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lines, 0) as lines, len(regexp_extract_all(text, '\\p{{Lu}}')) as uppers,
            len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as stutters from d left join cov using (doc_id) left join lin using (doc_id)),
        b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 10 * n_symbols <= n_words and 10 * stutters <= 3 * n_words
            and word_chars between 2 * n_words and 15 * n_words and 10 * n_dup_lines <= 5 * lines and 2 * uppers <= word_chars as kept from b"""


def _sql5() -> str:
    """No page of the tables has a canonical link or a refresh, so the method's verdict is its default."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"when ('.' || host) like '%.{h}' and starts_with(path, '{p}') then" for _, h, p in rules]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, rules))
    return f"""select page_id, host, path, case {rule} end as rule, case {verdict} else 'allow' end as verdict from (select page_id,
        case when instr(url, '://') > 0 then lower(regexp_extract(rest, '^[^/?#]*')) else '' end as host, case when instr(url, '://') > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path
        from (select page_id, url, substr(url, instr(url, '://') + 3) as rest from pages))"""


def _sql5_redirects() -> str:
    return f"""with recursive p as (select *, regexp_extract(substr(url, instr(url, '://') + 3), '^[^#]*') as n from ({_sql5()}) join (select page_id, url from pages) using (page_id)),
        h as (select page_id, page_id + 1 as q from pages where page_id % 3 = 0 union all select page_id, page_id + 2 from pages where page_id % 5 = 0),
        e as (select a.n as a, b.n as b from h join p a using (page_id) join p b on b.page_id = h.q), d as (select a, b from e union select b, a from e),
        r(a, b) as (select a, b from d union select r.a, d.b from r join d on r.b = d.a),
        v as (select r.a as n, bool_or(p.rule is not null and p.verdict = 'allow') as allowed, bool_or(p.rule is not null and p.verdict = 'block') as blocked from r join p on p.n = r.b group by r.a)
        select page_id, rule, case when rule is not null then verdict when blocked and not allowed then 'block' else 'allow' end as verdict,
            case when rule is not null then 'rule' when blocked and not allowed then 'component' else 'default' end as via from p left join v using (n)"""


def _sql10() -> str:
    import math
    import re
    from collections import Counter

    weight, other = license_scan.idf()
    rows = []
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        tf = Counter(re.findall(license_scan.TOKEN, text.lower()))
        norm = math.sqrt(sum((c * weight[w]) ** 2 for w, c in tf.items()))
        rows += [f"({i}, '{name}', '{w}', {c * weight[w] / norm!r}::double, {int(w in license_scan.required(name, text))})" for w, c in sorted(tf.items())]
    words = ", ".join(f"('{w}', {x!r}::double)" for w, x in sorted(weight.items()))
    header, mark = license_scan.HEADER.removeprefix("(?i)"), license_scan.COMMENT_MARK
    word = license_scan.HEADER_WORD
    cuts = ", ".join(f"array_to_string(w[greatest(i - {back}, 1):greatest(i - {back}, 1) + {n - 1}], ' ')" for back in (0, 3) for n in license_scan.WINDOWS)
    return f"""with t(template, license, word, unit, need) as (values {", ".join(rows)}), i(word, idf) as (values {words}),
        named as (select doc_id, text from documents where regexp_matches(text, '(?i){header}')),
        tok as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '{mark}', ' ', 'g')), '{license_scan.TOKEN}') as w from named),
        seg as (select distinct doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from named) where regexp_matches(l, '(?i){header}')
            union select doc_id, unnest([{cuts}]) from (select doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda k: regexp_matches(w[k], '{word}'))) as i from tok)),
        tf as (select doc_id, l, word, count(*) * coalesce(any_value(idf), {other!r}) as w from (select doc_id, l, unnest(regexp_extract_all(lower(l), '{license_scan.TOKEN}')) as word from seg) left join i using (word) group by 1, 2, 3),
        nrm as (select doc_id, l, sqrt(sum(w * w)) as norm from tf group by 1, 2), n as (select template, sum(need) as needed from t group by 1),
        dot as (select doc_id, l, license, round(max(dot), 12) as dot from (select doc_id, l, template, license, sum(w * unit) as dot, sum(need) as met from tf join t using (word) group by 1, 2, 3, 4) join n using (template) where met = needed group by 1, 2, 3),
        best as (select doc_id, l, license, dot / norm as cosine, row_number() over (partition by doc_id, l order by dot desc, license) as r from dot join nrm using (doc_id, l)),
        told as (select a.doc_id, a.license, a.cosine from best a left join best b on a.doc_id = b.doc_id and a.l = b.l and b.r = 2 where a.r = 1 and a.cosine - coalesce(b.cosine, -1) >= {license_scan.MARGIN} and a.cosine >= {license_scan.THRESHOLD - 1e-9}
            union all select doc_id, license, 1.0 from (select doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '{license_scan.SPDX}', 1)), '[()]', '', 'g'), '(-only|-or-later|[+])($|[ \\t])', '\\2', 'g') as license from named) where license not in ('NONE', 'NOASSERTION')),
        own as (select doc_id, license, round(cosine, 6) as cosine from (select *, row_number() over (partition by doc_id order by round(cosine, 9) desc, license) as n from told) where n = 1)
        select doc_id, license, cosine, case when license is not null then 'own' end as found from documents left join own using (doc_id)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an expression's ASCII text, bit by bit."""
    byte = "list_transform(string_split(%s, ''), lambda x: ascii(x)::bigint)" % text
    shift = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: {shift}), 4294967295)"


def _sql11() -> str:
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    # A tree's levels, and from the leaf up its proof and what a claim folds to.
    up = """select g, l + 1, p // 3, sha256(string_agg(h, '' order by p)), (any_value(n) + 2) // 3 from {t} where n > 1 group by g, l, p // 3"""
    step = """select f.g, f.l + 1, f.p // 3, f.d, f.c, f.s || coalesce((select string_agg(h, '' order by p) from {t} t where t.g = f.g and t.l = f.l and t.p // 3 = f.p // 3 and t.p <> f.p), ''),
        sha256((select string_agg(case when t.p = f.p then f.x else h end, '' order by p) from {t} t where t.g = f.g and t.l = f.l and t.p // 3 = f.p // 3)), f.n from {f} f where f.l < f.n"""
    return f"""with recursive d as (select doc_id, case when source is null then '' else '=' || source end as g, sha256({fields("text")}) as leaf,
            sha256({fields(f"(case when {_crc32('doc_id::varchar')} % 2 = 0 then replace(text, chr(10), '') else text end)")}) as claim from documents),
        o as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as n from d),
        t(g, l, p, h, n) as (select g, 0, p, leaf, n from o union all ({up.format(t="t")})),
        sub as (select g, l, h from t where n = 1), so as (select g, h, row_number() over (order by g) - 1 as p, count(*) over () as n from sub),
        u(g, l, p, h, n) as (select '', 0, p, h, n from so union all ({up.format(t="u")})),
        f(g, l, p, d, c, s, x, n) as (select o.g, 0, p, doc_id, leaf, '', claim, sub.l from o join sub using (g) union all ({step.format(t="t", f="f")})),
        v(g, l, p, d, c, s, x, n) as (select '', 0, so.p, d, struct_pack(leaf := c, subroot := so.h), s, x, (select l from u where n = 1) from f join so using (g) where f.l = f.n union all ({step.format(t="u", f="v")}))
        select d as doc_id, c.leaf as leaf, c.subroot as subroot, r.h as root, sha256(s) as proof_sha256, x as folded_root, x = r.h as verified from v, (select h from u where n = 1) r where v.l = v.n"""


def _sql12() -> str:
    n, least = minhash_dedup.SHINGLE, round(100 * minhash_dedup.SIMILARITY)
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
        s as (select distinct doc_id, array_to_string(w[i:i + {n - 1}], ' ') as g from w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as t(i) where len(w) > 0),
        c as (select doc_id, count(*) as n from s group by doc_id), l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id
            join c x on x.doc_id = a.doc_id join c y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= {least} * (x.n + y.n - count(*))),
        e as (select a, b from l union all select b, a from l), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
        k as (select a as doc_id, min(b) as m from r group by a)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, doc_id = least(doc_id, coalesce(m, doc_id)) as kept from documents left join c using (doc_id) left join k using (doc_id)"""


def _sql13() -> str:
    """Equal words at each distance; as a period's run has four of them, a distance is a quarter of the words at most."""
    return f"""with d as (select doc_id, {_crc32("doc_id::varchar")} as h, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
        m as (select doc_id, w, len(w) as n, h // 10 % len(w) as a, h % 10 = 0 as again, 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8) as p from d where len(w) > 0),
        t as (select doc_id, case when again then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[1 + a + (i - a) % p] end) else w end as w from m),
        o as (select doc_id, i - 1 as i, w[i] as x, len(w) as n from t, unnest(range(1, len(w) + 1)) as u(i)),
        q as (select a.doc_id, a.i, b.i - a.i as p from o a join o b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
        g as (select doc_id, p, min(i) as start, count(*) + p as length from (select *, i - row_number() over (partition by doc_id, p order by i) as k from q) group by doc_id, p, k having count(*) >= 3 * p and count(*) + p >= 6),
        r as (select doc_id, start, length, min(p) as period from g group by doc_id, start, length),
        top as (select * from r qualify row_number() over (partition by doc_id order by length desc, start, period) = 1),
        s as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by doc_id),
        k as (select doc_id, string_agg(x, ' ' order by i) as words from o where not exists (select 1 from r where r.doc_id = o.doc_id and o.i >= r.start + r.period and o.i < r.start + r.length) group by doc_id)
        select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length::bigint as length, period, (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
        from d left join s using (doc_id) left join top using (doc_id) left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are held against brute force by the tests."""
    made = {"op1_voronoi_knn": _sql1, "op4_quality_rules": _sql4, "op5_url_filter": _sql5, "url_redirects": _sql5_redirects, "op10_license_scan": _sql10, "op11_merkle_manifest": _sql11, "op12_minhash_dedup": _sql12, "op13_periodic_runs": _sql13}
    return {name: " ".join(f().split()) for name, f in made.items()}
