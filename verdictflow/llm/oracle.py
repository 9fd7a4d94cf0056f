"""DuckDB SQL with the result of a query, where SQL can express it."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LM_SCORE = rf"""
with w as (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents
), steps as (
  select doc_id, pos, w[pos] word, case when pos > 1 then w[pos - 1] end before,
         case when pos > 2 then w[pos - 2] end first
  from w, unnest(range(1, len(w) + 1)) t(pos)
), words as (
  select word, round(ln(count(*)::double) * 1000000)::bigint n from steps group by word
), pairs as (
  select before, word, round(ln(count(*)::double) * 1000000)::bigint n from steps
  where before is not null group by before, word having count(*) >= 2
), triples as (
  select first, before, word, round(ln(count(*)::double) * 1000000)::bigint n from steps
  where first is not null group by first, before, word having count(*) >= 2
), facts as (
  select round(ln(greatest(count(*), 1)::double) * 1000000)::bigint total,
         round(ln(0.4::double) * 1000000)::bigint penalty from steps
), scored as (
  select doc_id, case when t.n is not null then t.n - c.n
                      when p.n is not null then p.n - b.n + penalty * (least(pos, 3) - 2)
                      else x.n - total + penalty * (least(pos, 3) - 1) end points
  from steps s cross join facts join words x on s.word = x.word
  left join words b on s.before = b.word left join pairs p on s.before = p.before and s.word = p.word
  left join pairs c on s.first = c.before and s.before = c.word
  left join triples t on s.first = t.first and s.before = t.before and s.word = t.word
), sums as (select doc_id, count(*) n_words, sum(points)::bigint micro from scored group by doc_id)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(micro, 0)::bigint micro_score,
       micro::double / n_words / 1000000 score
from documents d left join sums s on d.doc_id = s.doc_id
"""

JACCARD_JOIN = rf"""
with recursive w as (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents
), runs as (
  select distinct doc_id, array_to_string(w[pos:pos + 4], ' ') run
  from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(pos) where len(w) > 0
), sizes as (select doc_id, count(*) n from runs group by doc_id),
shared as (
  select a.doc_id a, b.doc_id b, count(*) n
  from runs a join runs b on a.run = b.run and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from shared s join sizes x on s.a = x.doc_id join sizes y on s.b = y.doc_id
  where 5 * s.n >= 4 * (x.n + y.n - s.n)
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), classes as (select a doc_id, min(b) least from reach group by a),
counts as (select a doc_id, count(*) n_links from links group by a)
select d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) class_id,
       coalesce(n_links, 0) n_links, coalesce(c.least, d.doc_id) >= d.doc_id kept
from documents d left join classes c on d.doc_id = c.doc_id left join counts n on d.doc_id = n.doc_id
"""

EMBEDDING_DEDUP = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
), ok as (
  select vec_id, label, e from v
  where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from ok a join ok b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), classes as (select a vec_id, min(b) least from reach group by a),
counts as (select a vec_id, count(*) n_links from links group by a)
select v.vec_id, coalesce(n_links, 0) n_links, least(v.vec_id, coalesce(least, v.vec_id)) component_id,
       coalesce(least, v.vec_id) >= v.vec_id kept
from v left join classes c on v.vec_id = c.vec_id left join counts n on v.vec_id = n.vec_id
"""

DECONTAMINATE = rf"""
with d as (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents
), i as (
  select item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) size,
         array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') run
  from i, unnest(range(1, greatest(len(w) - 8, 2))) t(pos) where len(w) > 0
), places as (
  select doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') run
  from d, (select distinct size from windows) s, unnest(range(1, len(w) - size + 2)) t(pos)
), found as (
  select doc_id, item_id, windows.size, pos from places join windows using (size, run)
), hits as (
  select doc_id, count(distinct n) n_hit from found, unnest(range(pos, pos + size)) t(n) group by doc_id
), ids as (
  select doc_id, count(item) n_items, string_agg(item, ',' order by item) items
  from (select distinct doc_id, cast(item_id as varchar) item from found) group by doc_id
)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
from d left join hits using (doc_id) left join ids using (doc_id)
"""

URL_FILTER = rf"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest
  from pages
), p as (
  select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from u
), r(rhost, rpath, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) rule,
         arg_max(verdict, length(rhost || rpath)) verdict
  from p join r on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
  group by page_id
)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict
from p left join best on p.page_id = best.page_id
"""

_SECRET_KINDS = [
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        "length(v) >= 6",
    ),
    ("access", "(AKIA[A-Z0-9]+)", 1, "length(v) >= 20"),
    ("hex", "([0-9a-f]{24,})", 1, "true"),
    (
        "secret",
        "([A-Za-z0-9+/]{32,})",
        1,
        "regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')"
        " and regexp_matches(v, '[0-9]')",
    ),
    ("endpoint", r"""([a-z]{2,12}://[^\x00-\x20"''<>]{4,})""", 1, "true"),
    (
        "login",
        r"([uU][sS][eE][rR][nN][aA][mM][eE]|[uU][sS][eE][rR]|[lL][oO][gG][iI][nN])"
        r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}""",
        1,
        "true",
    ),
]


def _secret_parts(rank, kind, pattern, group, keep):
    return rf"""
  select doc_id, {rank} rank, '{kind}' kind, b as "start", b + length(m) as "end" from (
    select doc_id, unnest(f) m, unnest(regexp_extract_all(s, '{pattern}', {group})) v,
           unnest(list_transform(range(1, len(f) + 1), lambda i:
             list_sum(list_transform(g[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))) b
    from (select doc_id, s, regexp_extract_all(s, '{pattern}') f,
                 regexp_split_to_array(s, '{pattern}') g
          from t where regexp_matches(s, '{pattern}'))
  ) where {keep}"""


def _within(kinds):
    names = ", ".join(f"'{k}'" for k in kinds)
    return (
        f"exists (select 1 from parts b where b.doc_id = a.doc_id and b.kind in ({names})"
        f' and abs(b."start" - a."start") <= 300)'
    )


_LISTED = """string_agg(kind || ':' || "start" || ':' || "end", ',' order by "start", rank)"""

SECRET_SCAN = f"""
with t as (select doc_id, coalesce(text, '') s from documents),
parts as (
  {" union all ".join(_secret_parts(i, *k) for i, k in enumerate(_SECRET_KINDS))}
), kept as (
  select * from parts a
  where rank < 3
     or kind = 'secret' and {_within(["access", "endpoint"])}
     or kind = 'login' and {_within(["assign", "hex", "secret"])} and {_within(["endpoint"])}
     or kind = 'endpoint' and {_within(["access"])} and {_within(["assign", "hex", "secret"])}
), found as (
  select doc_id, count(*) filter (kind = 'assign') n_assign,
         count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
         {_LISTED} filter (rank < 3) base, {_LISTED} spans
  from kept group by doc_id
)
select t.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access,
       coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from t left join found on t.doc_id = found.doc_id
"""

_BLANK = r"\x20\x09-\x0D"
# CRC-32 bit by bit: a byte is mixed in, then eight shifts (-1 in the list).
_CRC = """4294967295 - list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''),
  lambda c: list_concat([ascii(c)::bigint], list_transform(range(8), lambda k: -1::bigint)))),
  lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, (crc & 1) * 3988292384) end,
  4294967295::bigint)"""

RUNS = rf"""
with d as materialized (
  select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') w0,
         {_CRC} h from documents
), shape as (
  select *, h // 10 g, len(w0) n from d
), planted as (
  select *, case when h % 10 = 0 and n > 0 then g % n end a,
         case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end p from shape
), texts as materialized (
  select rid, doc_id, n, case when a is null then w0 else list_concat(w0[1:a],
    list_transform(range(a, n), lambda i: w0[a + (i - a) % p + 1])) end w from planted
), tok as materialized (
  select rid, n, i, w[i + 1] word from texts, unnest(range(n)) t(i)
), pairs as (
  select x.rid, y.i - x.i q, x.i from tok x join tok y on x.rid = y.rid and x.word = y.word
  where y.i > x.i and 4 * (y.i - x.i) <= x.n
), islands as (
  select rid, q, min(i) s, max(i) + 1 + q e
  from (select *, i - row_number() over (partition by rid, q order by i) part from pairs)
  group by rid, q, part having max(i) + 1 + q - min(i) >= greatest(6, 4 * q)
), runs as materialized (
  select rid, s, e - s length, min(q) q from islands group by rid, s, e
), top as (
  select a.* from runs a where not exists (
    select 1 from runs b where b.rid = a.rid and (b.length * a.q > a.length * b.q
      or b.length * a.q = a.length * b.q and (b.s, b.q) < (a.s, a.q)))
), lines as (
  select rid, count(*) n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) lines
  from runs group by rid
), gone as (
  select distinct rid, i from runs, unnest(range(s + q, s + length)) t(i)
), collapsed as (
  select rid, string_agg(word, ' ' order by i) text from tok anti join gone using (rid, i) group by rid
)
select doc_id, coalesce(n_runs, 0) n_runs, s "start", length, q "period", (1000 * length) // q exponent_milli,
       sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(c.text, '')) collapsed_sha256
from texts t left join lines using (rid) left join top using (rid) left join collapsed c using (rid)
"""


def _centroid_sql(clusters=40, rounds=5):
    parts = [
        """
v as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e
  from embeddings where len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"""
c0 as materialized (
  select row_number() over (order by h nulls last, e) - 1 k, e
  from (select e, sha256('2:' || vec_id) h from v order by h nulls last, e limit {clusters})
)""",
    ]
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        # Distance and number in one value: the least is the nearest, then the smallest number.
        parts.append(f"""
a{r} as materialized (
  select rid, best % 1000 k, best // 1000 distance
  from (select rid, min({square}::bigint * 1000 + c.k) best from v cross join c{r} c group by rid)
)""")
        if r < rounds:
            parts.append(f"""
m{r} as (
  select k, i, sum(x)::bigint s, count(*) n
  from (select k, unnest(e) x, generate_subscripts(e, 1) i from a{r} join v using (rid)) group by k, i
), f{r} as (
  select k, list((s - ((s % n) + n) % n) // n order by i) e from m{r} group by k
), c{r + 1} as materialized (
  select c.k, coalesce(f.e, c.e) e from c{r} c left join f{r} f using (k)
)""")
    return f"""
with {", ".join(parts)}
select vec_id, k::int "cluster", distance::bigint distance, (sum(distance) over (partition by k))::bigint cluster_inertia,
       (sum(distance) over ())::bigint inertia, sha256(array_to_string(c.e, ',')) centroid_sha256
from a{rounds} join v using (rid) join c{rounds} c using (k)
"""


EXACT_DEDUP = """
with d as (select doc_id, coalesce(text, '') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 kept, sha256(t) text_sha256
from d
"""

ORACLES = {
    "op1_lm_score": LM_SCORE,
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op2_jaccard_join": JACCARD_JOIN,
    "op6_decontaminate": DECONTAMINATE,
    "op8_url_filter": URL_FILTER,
    "op9_secret_scan": SECRET_SCAN,
    "op11_runs": RUNS,
    "op12_centroids": _centroid_sql(),
    "op13_exact_dedup": EXACT_DEDUP,
}
