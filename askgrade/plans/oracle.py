"""SQL twins of the registered queries, written for DuckDB.

Each is an independent statement over the same parquet tables: simple patterns that
are right for the markup these tables hold, windows instead of rank selection, plain
joins instead of in-row expressions.
"""

from __future__ import annotations

from askgrade.constants import ENGLISH_STOP_WORDS

# --- fixed values: the token rules, for RE2, written out here so that a slip in the engine's shows
TOKEN_RULES = [
    ("([^.])[.]([])}>\"']*)([ \\t\\n\\f\\r]+|$)", r"\1 . \2 "),
    (r"([.]{3}|-{2}|`{2}|'{2}|[]\[;@#$%&?!(){}<>\"])", r" \1 "),
    ("(:|,)([^0-9]|$)", r" \1 \2"),
    ("([^' ])('[dDmMsS]|')( |$)", r"\1 \2 "),
    ("([^' ])('ll|'re|'ve|n't|'LL|'RE|'VE|N'T)( |$)", r"\1 \2 "),
    (r"(?i)\b(d)('ye)\b|\b(mor)('n)\b| ('t)(is|was)\b", r" \1\3\5 \2\4\6 "),
    (r"(?i)\b(?:(can)(not)|(gim)(me)|(lem)(me)|(gon)(na)|(wan)(na)|(got)(ta))\b",
     r" \1\3\5\7\9 \2\4\6\8 "),
]
# --- fixed values: forms of the homework words, by length and alphabet
HOMEWORK_FORMS = """
    schoolteachers schoolteacher supervisors professors schoolworks schoolwork supervisor educations
    homeworks professor textbooks education exercises homework lectures teachers textbook colleges
    exercise college lecture schools teacher teaches school exams teach teachs exam
""".split()
ASSIGNMENT_FORMS = ["assignments", "assignment"]

TERM = r"[\p{L}\p{N}_]{2,}"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_literal(w) for w in words) + "]"


def _replace_all(x: str, pattern: str, replacement: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {_literal(pattern)}, {_literal(replacement)}, '{flags}')"


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"),
                         ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _collapse(x: str) -> str:
    return f"trim({_replace_all(x, r'\s+', ' ')})"


def _strip(x: str, boundary: str = "") -> str:
    return _replace_all(x, "<[^>]*>", boundary)


def _text(x: str) -> str:
    return _collapse(_unescape(_strip(_unescape(x))))


def _code(x: str) -> str:
    return _replace_all(x, "<code>[^<]*</code>", " has_codeblock ")


def _links(x: str) -> str:
    return _replace_all(x, "<a [^>]*>[^<]*</a>", " has_links ")


def _spaced(x: str) -> str:
    return _collapse(_unescape(_strip(x, " ")))


def _hex(x: str) -> str:
    pattern = r"(\b[^0-9a-f]0x\b)|([^0-9a-f]0x[0-9A-Z]+)"
    return _replace_all(x, pattern, " has_hexadecimal ", "gi")


def _numeric(x: str) -> str:
    return _replace_all(x, r"[+-]?\b\d+\b", " has_numeric ")


def _tokens(x: str) -> str:
    for pattern, replacement in TOKEN_RULES:
        x = _replace_all(x, pattern, replacement)
    return f"list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


# --- fixed values: what may stand around a word
AROUND = r"""^[ \t\n\f\r"'(<\[{]+|[] \t\n\f\r"')}>,;:!?]+$"""


def _bare(x: str) -> str:
    return _replace_all(f"lower({x})", AROUND, "")


def _abbreviations(source: str, column: str) -> str:
    """CTEs up to ``abbr (word, with_stop, without, score)``: scores by logarithms' sums."""
    return f"""bare as (select {_bare(f"unnest(string_split_regex({column}, '[ \t\n\f\r]+'))")} as b from {source}),
typed as (select {_replace_all('b', '[.]$', '', '')} as word, b like '%.' and b not like '%..' as stop from bare),
counts as (select word, count(*) filter (where stop) as with_stop, count(*) filter (where not stop) as without
  from typed where regexp_matches(word, '\\p{{L}}') and word not like '%.' group by word),
share as (select sum(with_stop) / sum(with_stop + without) as p from counts),
parts as (select word, with_stop, without, len(word) - len(replace(word, '.', '')) as dots,
  with_stop * ln(0.99 / greatest(p, 1e-12)) + without * ln(0.01 / greatest(1 - p, 1e-12)) as gain
  from counts, share where with_stop > 0),
abbr as (select word, with_stop, without, score from (select *, 2 * gain * (dots + 1) / exp(len(word) - dots)
  * pow(cast(len(word) - dots as double), -without) as score from parts) where score >= 0.3)"""


def _by_length(words: str) -> str:
    keyed = f"list_transform({words}, lambda w: {{'l': -length(w), 'w': w}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.w)"


def _own(tags: str) -> str:
    parts = f"string_split_regex(translate({tags}, '<>', '  '), '\\s+')"
    return _by_length(f"list_filter({parts}, lambda t: t <> '')")


def _fold(text: str, hits: str, marker: str) -> str:
    return f"list_reduce({hits}, lambda acc, w: replace(acc, w, {_literal(marker)}), {text})"


def _hits(words: str, tokens: str) -> str:
    return f"list_filter({words}, lambda w: list_contains({tokens}, w))"


def _word_list(source: str, forms: list[str], marker: str) -> str:
    """Rows of ``source`` (Id, Body) with the surface forms of a word list replaced."""
    hits = _hits(_list(sorted(forms, key=lambda w: (-len(w), w))), "k")
    folded = _fold("Body", hits, marker)
    return f"select Id, {folded} as Body from (select Id, Body, {_tokens('Body')} as k from {source})"


def _attached(source: str) -> str:
    folded = _fold("Body", _hits("own", "k"), " has_attached_tag ")
    return f"""select Id, Tags, {folded} as Body from (
      select Id, Tags, Body, {_own('Tags')} as own, {_tokens('Body')} as k from {source})"""


def _found(source: str) -> str:
    return f"""select Id, {_by_length('list(t)')} as found
      from (select Id, unnest({_tokens('Body')}) as t from {source})
      where t in (select TagName from site_tags) group by Id"""


def _external(source: str, found: str) -> str:
    folded = _fold("Body", "found", " has_external_tag ")
    return f"""select s.Id, case when found is null then Body else {folded} end as Body
      from {source} s left join {found} f on f.Id = s.Id"""


POSTS = f"""
words as (select doc_id, regexp_extract_all(lower(text), '{TERM}') as l from documents),
three as (select doc_id, list_slice({_by_length("list_distinct(l)")}, 1, 3) as t from words),
posts as (
  select d.doc_id as Id,
    cast(((d.doc_id * 7919) % 241) - 60 as integer) as Score,
    cast(null as integer) as ViewCount,
    concat('<p>', text, '</p>',
      case when d.doc_id % 3 = 0 then concat('<pre><code>x = ', cast(d.doc_id as varchar), '</code></pre>') else '' end,
      case when d.doc_id % 4 = 0 then concat('<p>see <a href="http://e.org/', cast(d.doc_id as varchar), '">', source, '</a>.</p>') else '' end,
      case when d.doc_id % 5 = 0 then concat('<p>at 0x', cast(d.doc_id as varchar), ' end</p>') else '' end,
      case when d.doc_id % 7 = 0 then '<p>this is homework for school</p>' else '' end,
      case when d.doc_id % 11 = 0 then '<p>my assignment is late</p>' else '' end) as Body,
    split_part(text, chr(10), 1) as Title,
    cast(null as integer) as AnswerCount,
    cast(null as integer) as CommentCount,
    cast(null as integer) as AcceptedAnswerId,
    cast(null as integer) as OwnerUserId,
    cast(null as timestamp) as CreationDate,
    array_to_string(list_transform(t, lambda x: '<' || x || '>'), '') as Tags,
    cast(null as timestamp) as ClosedDate
  from documents d join three using (doc_id)),
site_tags as (
  select distinct TagName from (select unnest(t) as TagName from three)),
classes as (
  select *, case when Score < -5 then -1 else 1 end as label from posts where Score < -5 or Score > 50),
raw as (select *, cast(length(Body) as integer) as length from classes),
pages_ as (select page_id as Id, html as Body from pages),
predictions as (
  select doc_id as Id, quality * 2 - 1 as label, (1 - toxic) * 2 - 1 as prediction from labels)
"""
STRIPPED = f"stripped as (select * replace (lower({_text('Body')}) as Body) from raw)"
MARKED = f"""
spaced as (select Id, Tags, label,
  {_numeric(_hex(_spaced(_links(_code(_unescape('lower(Body)'))))))} as Body from raw),
tagged as ({_attached('spaced')}),
homeworked as ({_word_list('tagged', HOMEWORK_FORMS, ' has_homework ')}),
marked as (select h.Id, h.Body, r.label, cast(length(h.Body) as integer) as length
           from homeworked h join raw r on r.Id = h.Id)
"""
SINGLE = f"""
s_codeblock as (select Id, {_spaced(_code('Body'))} as Body, label, length from raw),
s_links as (select Id, {_spaced(_links('Body'))} as Body, label, length from raw),
s_homework0 as ({_word_list('stripped', HOMEWORK_FORMS, ' has_homework ')}),
s_homework1 as ({_word_list('s_homework0', ASSIGNMENT_FORMS, ' has_assignment ')}),
s_homework as (select h.Id, h.Body, label, length from s_homework1 h join raw r on r.Id = h.Id),
s_numeric as (select Id, {_numeric('Body')} as Body, label, length from stripped),
s_hexadecimal as (select Id, {_hex('Body')} as Body, label, length from stripped),
s_tags0 as ({_attached('stripped')}),
s_tags as (select t.Id, t.Body, label, length from s_tags0 t join raw r on r.Id = t.Id)
"""
TERMS = f"""
doc_terms as (select Id, regexp_extract_all(lower(Body), '{TERM}') as l from stripped),
tf as (select Id, term, count(*) as tf from (select Id, unnest(l) as term from doc_terms) group by Id, term),
sizes as (select count(*) as n from stripped),
vocabulary as (select term, count(*) as df, any_value(n) as n from tf, sizes group by term)
"""
ALL = f"with {POSTS}, {STRIPPED}, {MARKED}, {SINGLE}, {TERMS}"
BASE = f"with {POSTS}"

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, select: str, prelude: str = ALL) -> None:
    ORACLE_SQL[name] = f"{prelude}\n{select}" if prelude else select


# --- sources and sinks
_add("s1_read_bad_questions", "select *, -1 as label from posts where Score < -5", BASE)
_add("s1_read_by_score_band", "select Id, Score, label, length from raw", BASE)
_add("s2_load_tags", "select TagName from site_tags order by TagName", BASE)
_add("s2_tags_csv", "select TagName from site_tags order by TagName", BASE)
_add("s3_table_preview", "select * from part order by p_partkey limit 1000", "")
_add("s4_s5_csv_round_trip", """select s.Id, r.Score, s.Body, r.Title, r.Tags, s.label, s.length
  from s_numeric s join raw r on r.Id = s.Id""")
_add("s6_load_variant_stripped", "select Id, Body from stripped")
_add("s9_cached_dataset", "select Id, Body from stripped")
_add("s7_libsvm_round_trip", """select label, count(distinct r.Id) as questions,
  count(kept.term) as entries, cast(coalesce(sum(kept.tf), 0) as bigint) as occurrences
  from raw r left join (select tf.* from tf join vocabulary using (term) where df >= 0.01::double * n) kept
    on kept.Id = r.Id group by label""")

# --- projections, predicates, limits, unions, sorts
_add("p1_projection", "select * from posts", BASE)
_add("p2_p3_label_and_length", "select Id, label, length from raw", BASE)
_add("p4_lowercase", "select Id, lower(Body) as Body from raw", BASE)
_add("f1_score_classes", "select Id, Score, label from raw", BASE)
_add("f2_thresholds", """select case when Score < -20 then -1 else 1 end as label, count(*) as questions,
    'own' as thresholds from posts where Score < -20 or Score > 100 group by 1
  union all select label, count(*), 'default' from raw group by label""", BASE)
_add("f3_drop_uncleanable", f"""select Id, {_text('Body')} as Body from posts
  where Id in (select doc_id from labels where quality is not null)""", BASE)
_add("f4_questions_with_numeric", "select Id, label from marked where contains(Body, ' has_numeric ')")
_add("f4_questions_with_codeblock_padded",
     "select Id, label from marked where contains(' ' || Body || ' ', ' has_codeblock ')")
_add("f5_questions_with_homework_or_assignment", """select Id, label from s_homework
  where contains(Body, ' has_homework ') or contains(Body, ' has_assignment ')""")
_ANY = " or ".join(
    f"contains(Body, ' has_{m} ')"
    for m in ("codeblock", "links", "attached_tag", "hexadecimal", "numeric", "homework")
)
_add("f6_questions_with_any_marker", f"select Id, label from marked where {_ANY}")
_add("l1_first_per_class", """select Id, label, Score from raw
  qualify row_number() over (partition by label order by Id) <= 100""", BASE)
_add("u1_append_classes", """select Id, Score, Body, -1 as label from posts where Score < -5
  union all select Id, Score, Body, 1 from posts where Score > 50""", BASE)
_add("u2_row_index", """select row_number() over (order by label, Id) - 1 as row_idx, Id, label
  from raw""", BASE)
_add("o1_tags_alphabetical",
     f"select Id, array_to_string(list_sort({_own('Tags')}), ' ') as tags from posts", BASE)
_add("o2_tags_longest_first",
     f"select Id, array_to_string({_own('Tags')}, ' ') as tags from posts", BASE)

# --- joins
_add("j1_stripped_half_of_pair", """select s.Id, s.Body from stripped s join s_numeric n on n.Id = s.Id
  where contains(n.Body, ' has_numeric ')""")
_add("j2_own_tags", f"""select Id, cast(generate_subscripts(own, 1) - 1 as integer) as position, unnest(own) as tag
  from (select Id, {_own('Tags')} as own from posts)""", BASE)
_add("j3_site_tags_in_text",
     f"select Id, array_to_string(found, ' ') as found from ({_found('stripped')})")

_REPORT = """
  hits as (select {v} c.label, count(*) filter (where p.label = c.label and p.prediction = c.label) as hit,
      count(*) filter (where p.prediction = c.label) as predicted,
      count(*) filter (where p.label = c.label) as support
    from {source} p, (values (-1), (1)) c(label) group by {v} c.label),
  rates as (select *, case when predicted > 0 then hit / predicted else 0.0 end as p,
      case when support > 0 then hit / support else 0.0 end as r from hits),
  report as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from rates)
"""
_add("j4_effect_against_baseline", f"""{BASE},
  variants as (select 'baseline' as variant, label, prediction from predictions
    union all select 'always_good', label, 1 from predictions
    union all select 'reversed', label, -prediction from predictions),
  {_REPORT.format(v='variant,', source='variants')},
  long as (
    select variant, 'precision' as metric, sum(p * support) / sum(support) as value from report group by 1
    union all select variant, 'recall', sum(r * support) / sum(support) from report group by 1
    union all select variant, 'f1', sum(f * support) / sum(support) from report group by 1)
select l.variant, l.metric, round(l.value, 6) as value, round(b.value, 6) as baseline_value,
  round(l.value - b.value, 6) as delta
from long l join long b on b.metric = l.metric and b.variant = 'baseline'""", "")

# --- text
_add("t1_unescape", f"select Id, {_unescape('Body')} as Body from pages_", BASE)
_add("t2_code_marker", f"select Id, {_code('Body')} as Body from raw", BASE)
_add("t3_link_marker", f"select Id, {_links('Body')} as Body from raw", BASE)
_add("t2_t3_markers_exact", f"select Id, {_spaced(_links(_code(_unescape('Body'))))} as Body from raw", BASE)
_SCRIPT = "replace(Body, '\"</p>\"', '\"§/p>\"')"
_PAGE = f"replace({_text(_SCRIPT)}, '\"§/p>\"', '\"</p>\"')"
_add("t4_strip_pages", f"select Id, {_PAGE} as Body from pages_", BASE)
_add("t4_strip_losing_tails", f"""select Id, {_PAGE} as Body from (
  select Id, Body || case when Id % 3 = 0 then ' if a ' else '' end as Body from pages_)""", BASE)
_LINKED = f"replace({_spaced(_links(_unescape(_SCRIPT)))}, '\"§/p>\"', '\"</p>\"')"
_add("t4_strip_pages_keeping_links_marked", f"select Id, {_LINKED} as Body from pages_", BASE)
_add("t5_collapse_whitespace", f"select doc_id, {_collapse('text')} as text from documents", "")
_add("t6_hexadecimal_marker", f"select Id, {_hex('Body')} as Body from raw", BASE)
_add("t7_numeric_marker", f"select Id, {_numeric('Body')} as Body from raw", BASE)
_add("t8_word_tokens", f"""select Id, cast(len(k) as integer) as tokens,
  md5(array_to_string(list_sort(k), ' ')) as digest from (select Id, {_tokens('Body')} as k from stripped)""")
_add("t8_abbreviations", f"""with {_abbreviations('documents', 'text')}
  select word, with_stop, without, round(score, 6) as score from abbr""", "")
_CUT = _replace_all("x", *TOKEN_RULES[0])
_SENTENCES = "array_to_string(y, '')"
for _pattern, _replacement in TOKEN_RULES[1:]:
    _SENTENCES = _replace_all(_SENTENCES, _pattern, _replacement)
_add("t8_sentence_tokens", f"""{ALL}, {_abbreviations('stripped', 'Body')},
  t8_known as (select coalesce(list(word), []) as k from abbr),
  t8_pieces as (select Id, regexp_extract_all(Body, '\\s*[^ \t\n\f\r]+\\s*') as x from stripped),
  t8_cut as (select Id, list_transform(x, lambda x, i: case when i < len(t8_pieces.x) and b.d[i] like '%.' and b.d[i] not like '%..'
      and (regexp_matches(b.d[i], '^\\p{{L}}[.]$') or list_contains(k, b.d[i][:-2])) then x else {_CUT} end) as y
    from t8_pieces, t8_known, lateral (select list_transform(t8_pieces.x, lambda w: {_bare('w')}) as d) b),
  t8_tokens as (select Id, list_filter(list_distinct(string_split_regex({_SENTENCES}, '\\s+')), lambda w: w <> '') as t from t8_cut)
  select Id, cast(len(t) as integer) as tokens, md5(array_to_string(list_sort(t), ' ')) as digest from t8_tokens""", "")
_add("t9_tag_array", f"""select Id, cast(len(own) as integer) as n, array_to_string(own, ',') as tags
  from (select Id, {_own('Tags')} as own from posts)""", BASE)
_add("t10_replace_words", f"""select Id, {_fold('Body', _hits('own', 'k'), ' M ')} as Body
  from (select Id, Body, {_own('Tags')} as own, {_tokens('Body')} as k from stripped)""")
_add("t11_attached_tag_marker", "select Id, Body from s_tags")
_DIGEST = "cast(length(Body) as integer) as n, md5(Body) as digest"
_add("t11_external_tag_marker", f"""{ALL}, found as ({_found('stripped')}),
  done as ({_external('stripped', 'found')}) select Id, {_DIGEST} from done""", "")
_add("t12_homework_marker", _word_list("stripped", HOMEWORK_FORMS, " has_homework "))
_add("t13_assignment_marker", _word_list("stripped", ASSIGNMENT_FORMS, " has_assignment "))
_VERSION = _replace_all("t", r"\b(?:v\.?|vno\.?|version)\s*\d+(?:\.\d+)*", " has_version_number ", "gi")
_add("t14_version_marker", f"""select doc_id, {_VERSION} as "on", true as off_is_identity
  from (select doc_id, 'version ' || doc_id || ': ' || text as t from documents)""", "")
_add("t16_clean_all_markers", f"""{ALL}, found as ({_found('tagged')}),
  ext as ({_external('tagged', 'found')}), hw as ({_word_list('ext', HOMEWORK_FORMS, ' has_homework ')}),
  done as ({_word_list('hw', ASSIGNMENT_FORMS, ' has_assignment ')}) select Id, {_DIGEST} from done""", "")

# --- data sets
_add("d1_raw_set", "select * from raw", BASE)
_add("d2_stripped_set", "select Id, Body, label, length from stripped")
_add("d3_marked_set", "select Id, Body, label, length from marked")
for _name, _set in (("d4a_codeblock_set", "s_codeblock"), ("d4b_links_set", "s_links"),
                    ("d4c_homework_set", "s_homework"), ("d4d_numeric_set", "s_numeric"),
                    ("d4e_hexadecimal_set", "s_hexadecimal")):
    _add(_name, f"select Id, Body, label, length from {_set}")
_add("d4f_tags_set", f"""{ALL}, found as ({_found('s_tags')}), done as ({_external('s_tags', 'found')})
  select Id, {_DIGEST} from done""", "")
_SETS = ("codeblock", "links", "homework", "numeric", "hexadecimal", "tags")
_BOTH_TAGS = f"""{ALL}, found as ({_found('s_tags')}), done as ({_external('s_tags', 'found')}),
s_both_tags as (select d.Id, d.Body, r.label from done d join raw r on r.Id = d.Id)
"""
_add("d4_all_single_marker_sets", _BOTH_TAGS + "\nunion all ".join(
    f"select '{s}' as marker, label, count(*) as questions, cast(sum(length(Body)) as bigint) as characters "
    f"from {'s_both_tags' if s == 'tags' else 's_' + s} group by label" for s in _SETS), "")  # fmt: skip


def _pair(name: str, source: str, names: list[str]) -> str:
    having = " or ".join(f"contains(m.Body, ' has_{n} ')" for n in names)
    return f"""select '{name}' as "set", 'marked' as half, m.Id, m.Body from {source} m where {having}
  union all select '{name}', 'stripped', s.Id, s.Body from stripped s join {source} m on m.Id = s.Id
  where {having}"""


_add("d5a_extraction_pairs_one_marker", "\nunion all ".join(
    _pair(n, f"s_{n}", [n]) for n in ("hexadecimal", "numeric", "links", "codeblock")))
_add("d5b_extraction_pairs_either_marker", _BOTH_TAGS + "\nunion all ".join([
    _pair("tags", "s_both_tags", ["attached_tag", "external_tag"]),
    _pair("homework", "s_homework", ["homework", "assignment"])]), "")
_add("d5c_extraction_pair_any_marker", _pair("all", "marked", [
    "codeblock", "links", "attached_tag", "hexadecimal", "numeric", "homework"]))

# --- vectorisation
_add("v1_terms", """select Id, cast(len(l) as integer) as terms, md5(array_to_string(l, ' ')) as digest
  from doc_terms""")
_add("v2_terms_without_stop_words", f"""select Id, cast(len(l) as integer) as terms,
    md5(array_to_string(l, ' ')) as digest
  from (select Id, list_filter(l, lambda w: not list_contains({_list(ENGLISH_STOP_WORDS)}, w)) as l from doc_terms)""")
_add("v3_term_counts", "select Id, term, tf from tf")
_add("v4_vocabulary", "select term, df, n from vocabulary where df >= 0.01::double * n and df <= 0.95::double * n")
_add("v5_smooth_idf", "select term, round(ln((n + 1) / (df + 1)) + 1, 6) as idf from vocabulary")


def _weights(low, high, idf=True, norm="l2", twice=False, stop=False) -> str:
    weight = "ln((n + 1) / (df + 1)) + 1" if idf else "1.0"
    total = {"l1": "sum(abs({v})) over (partition by Id)", "l2": "sqrt(sum({v} * {v}) over (partition by Id))"}[norm]
    without = f" and not list_contains({_list(ENGLISH_STOP_WORDS)}, term)" if stop else ""
    once = f"""w0 as (select Id, term, {weight} as w, tf * ({weight}) as v from tf join vocabulary using (term)
      where df >= {low}::double * n and df <= {high}::double * n{without}),
    w1 as (select Id, term, w, v / {total.format(v='v')} as v from w0)"""
    last = "w1"
    if twice:
        once += f""", w2 as (select Id, term, w, v * w as v from w1),
    w3 as (select Id, term, w, v / {total.format(v='v')} as v from w2)"""
        last = "w3"
    return f"{ALL}, {once} select Id, term, round(v, 6) as value from {last}"


_add("v6_tfidf_l2", _weights(0.01, 0.95), "")
_add("s8_saved_feature_model", _weights(0.01, 0.95), "")
_add("v6_tfidf_l1_without_idf", _weights(0.025, 0.75, idf=False, norm="l1"), "")
_add("v6_tfidf_vectors", _weights(0.01, 0.95, stop=True), "")
_add("v7_tfidf_twice", _weights(0.01, 1.0, twice=True), "")
_add("v8_bigrams", """select ngram, count(*) as occurrences from (
    select unnest(l) as ngram from doc_terms
    union all select unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) from doc_terms)
  group by ngram""")

# --- splitting
_add("m0_binary_labels", "select Id, label, (label + 1) / 2.0::double as y, label as back from raw", BASE)
_add("m1_holdout_split", """select Id, label,
  row_number() over (order by md5(Id || ':0')) <= ceil(0.2::double * count(*) over ()) as is_test from raw""", BASE)
_add("m2_stratified_folds", """select Id, label,
  cast(ntile(5) over (partition by label order by Id) - 1 as integer) as fold from raw""", BASE)

# --- metrics
_add("a1_accuracy", """select round(avg(case when label = prediction then 1.0::double else 0.0 end), 6) as accuracy
  from predictions""", BASE)
_add("a2_confusion_matrix", """select label, count(*) filter (where prediction = -1) as predicted_bad,
  count(*) filter (where prediction = 1) as predicted_good from predictions group by label""", BASE)
_add("a3_classification_report", f"""{BASE}, {_REPORT.format(v='', source='predictions')}
select cast(label as varchar) as "class", round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, support
  from report
union all select 'avg / total', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  cast(sum(support) as bigint) from report""", "")
_FOLDS = f"""{BASE},
  folds as (select *, ntile(5) over (partition by label order by Id) - 1 as fold from predictions),
  rules as (select 0 as point, fold, label = prediction as hit from folds
    union all select 1, fold, label = 1 from folds union all select 2, fold, label = -prediction from folds),
  scores as (select point, fold, avg(hit::integer) as score from rules group by point, fold),
  summary as (select point, avg(score) as mean_score, stddev_pop(score) as std_score from scores group by point)"""
_add("a4_cv_summary", f"""{_FOLDS}
select point, round(mean_score, 6) as mean_score, round(std_score, 6) as std_score from summary""", "")
_add("a5_best_point", f"""{_FOLDS}
select point, round(mean_score, 6) as mean_score from summary order by summary.mean_score desc, point limit 1""", "")
_add("a6_document_frequencies", "select term, df from vocabulary")
_add("a7_marker_counts", "select label, count(*) as questions, " + ", ".join(
    f"count(*) filter (where contains(Body, ' has_{m} ')) as {m}"
    for m in ("codeblock", "links", "hexadecimal", "numeric", "attached_tag", "homework", "assignment"))
    + " from marked group by label")
_add("a8_class_sizes", "select label, count(*) as questions from raw group by label", BASE)
_add("marker_profile", """select label, count(*) as questions,
  count(*) filter (where contains(Body, ' has_numeric ')) as with_numeric, round(avg(length), 6) as mean_length
  from s_numeric group by label""")
