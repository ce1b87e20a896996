"""SQL of the core queries, for DuckDB. The name of each is its query's in capitals."""

# Fixed values, written out here and not taken from the code under test.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = "square ways integers dollars mph inches ft hours km units \\ldots sue points feet minutes digits cents degrees cm gm pounds meters meals edges students childrentickets multiples \\text{s} \\text{.}".split() + ["\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]
COMMON = "the be to of and that have with".split()
STOPWORDS = {
    "de": "der die das und ist nicht ein eine wir haben".split(), "en": "the and of to is that was it with for".split(), "es": "el la los que y en es una por muy".split(),
    "fr": "le la les des et est une que pas pour".split(), "it": "il la che di non per una è gli molto".split(), "nl": "de het een en is van niet dat wij heel".split(), "pt": "o a os que e não uma para muito é".split(),
}
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
_MASKS = ("|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||")

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_LS = r"\r\n|[\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words(c: str) -> str:
    return f"(CASE WHEN {_strip(c)} = '' THEN []::VARCHAR[] ELSE string_split_regex({_strip(c)}, '{_WS}+') END)"


def _lines(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({c}, '(?:{_LS})\\z', ''), '{_LS}') END)"


def _count(c: str, x: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, {_q(x)}, ''))) / {len(x)} AS INTEGER)"


_COMMON = " + ".join(f"CAST((contains(low, ' {w} ') OR starts_with(low, '{w} ') OR ends_with(low, ' {w}')) AS INTEGER)" for w in COMMON)
_RULES = f"""
rules0 AS (SELECT *, {_words('text')} AS w, {_lines('text')} AS ln, lower(text) AS low FROM src),
rules1 AS (SELECT * EXCLUDE (w, ln, low), CAST(len(w) AS INTEGER) AS n_words, CAST(len(ln) AS INTEGER) AS n_lines,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), CASE WHEN w IS NULL THEN NULL ELSE 0 END) AS INTEGER) AS word_chars,
  CAST(len(list_filter(ln, lambda x: ends_with({_strip('x')}, '...'))) AS INTEGER) AS n_ellipsis_lines,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS INTEGER) AS n_alpha_words,
  {_count('text', '#')} AS n_hashes, {_count('text', '…')} AS n_ellipses,
  CAST(len(list_filter(ln, lambda x: regexp_matches(regexp_replace(x, '^{_WS}+', ''), '^[-*•] '))) AS INTEGER) AS n_bullet_lines,
  {_COMMON} AS n_common, w FROM rules0),
rules AS (SELECT *, CASE WHEN text IS NULL THEN 'null' WHEN NOT (n_words BETWEEN 50 AND 100000) THEN 'word_count'
  WHEN word_chars / n_words < 3 OR word_chars / n_words > 10 THEN 'word_length' WHEN n_lines > 0 AND n_ellipsis_lines / n_lines > 0.3 THEN 'ellipsis_lines'
  WHEN n_alpha_words / n_words < 0.8 THEN 'alpha_words' WHEN n_hashes / n_words > 0.1 THEN 'hashes' WHEN n_ellipses / n_words > 0.1 THEN 'ellipses'
  WHEN n_lines > 0 AND n_bullet_lines / n_lines > 0.9 THEN 'bullets' WHEN n_common < 2 THEN 'common_words' END AS failed FROM rules1)"""
_TTR = "(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END)"

FLT3_QUALITY_RULES = f"WITH src AS (SELECT doc_id, text FROM documents), {_RULES} SELECT doc_id, n_words, n_lines, word_chars, n_ellipsis_lines, n_alpha_words, n_hashes, n_ellipses, n_bullet_lines, n_common, failed FROM rules"
FLT7_TYPE_TOKEN_RATIO = f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, round({_TTR}, 6) AS ttr FROM (SELECT doc_id, {_words('text')} AS w FROM documents)"
_STAGED = f"""WITH src AS (SELECT doc_id, text, lang, coalesce(source, '(none)') AS source FROM documents), {_RULES},
st AS (SELECT source, coalesce({_strip('text')} <> '', false) AS s1, coalesce(lang = 'en', false) AS s2, failed IS NULL AS s3, {_TTR} >= 0.2 AS s4 FROM rules)
"""
_SUMS = "count(*) AS n_records, " + ", ".join(f"CAST(count_if({' AND '.join(f's{i}' for i in range(1, k + 1))}) AS BIGINT) AS n_{n}" for k, n in enumerate(("text", "lang", "rules", "ratio"), 1))
FLT9_FUNNEL = f"{_STAGED} SELECT source, {_SUMS} FROM st GROUP BY source UNION ALL SELECT '(all)', {_SUMS} FROM st"
FLT10_BERNOULLI_SAMPLE = f"SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5('1-' || doc_id), 1, 8) AS BIGINT) < {int(0.02 * (1 << 32))}"

_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(_q, v))}))) AS h_{k}" for k, v in sorted(STOPWORDS.items()))
_LANGS = sorted(STOPWORDS)
CLS1_LANGUAGE = f"""WITH a AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents), b AS (SELECT doc_id, {_HITS} FROM a),
c AS (SELECT *, greatest({', '.join('h_' + k for k in _LANGS)}) AS m, {' + '.join('h_' + k for k in _LANGS)} AS t FROM b)
SELECT doc_id, CASE WHEN m IS NULL OR m = 0 THEN NULL {' '.join(f"WHEN h_{k} = m THEN '{k}'" for k in _LANGS)} END AS identified, CASE WHEN t > 0 THEN round(m / t, 6) END AS score FROM c"""

_PHONE = r"(^|[^0-9])(?:\+?1[\s.-]?)?(?:\(?[0-9]{3}\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}($|[^0-9])"


def _masked(id_col: str, table: str) -> str:
    """Twice for phones: the sign between two numbers belongs to one match only."""
    phones = f"regexp_replace({{}}, {_q(_PHONE)}, {_q(chr(92) + '1' + _MASKS[1] + chr(92) + '2')}, 'g')"
    twice = phones.replace("{}", phones.replace("{}", "m", 1), 1)
    return f"""a AS (SELECT {id_col}, text, CAST(len(regexp_extract_all(text, {_q(_EMAIL)})) AS INTEGER) AS n_emails, regexp_replace(text, {_q(_EMAIL)}, {_q(_MASKS[0])}, 'g') AS m FROM {table}),
    b AS (SELECT *, {twice} AS p FROM a),
    c AS (SELECT *, {_count('p', _MASKS[1])} - {_count('m', _MASKS[1])} AS n_phones, CAST(len(regexp_extract_all(p, {_q(_IP)})) AS INTEGER) AS n_ips, regexp_replace(p, {_q(_IP)}, {_q(_MASKS[2])}, 'g') AS masked FROM b)"""


PII_MASKS = f"WITH {_masked('doc_id', 'documents')} SELECT doc_id, n_emails, CAST(n_phones AS INTEGER) AS n_phones, n_ips, md5(masked) AS masked_md5 FROM c"
PII_WET_MASKS = f"WITH {_masked('record_id', 'wet_record')} SELECT record_id, n_emails, CAST(n_phones AS INTEGER) AS n_phones, n_ips, masked FROM c WHERE n_emails + n_phones + n_ips > 0"
PRJ_NORMAL_FORMS = f"""SELECT doc_id, md5(replace(text, chr(10), ' ')) AS blanks_md5, md5(regexp_replace(regexp_replace(text, '(?:{_LS})\\z', ''), '{_LS}', ' ', 'g')) AS joined_md5,
md5({_strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")}) AS collapsed_md5, {_strip("replace(substr(text, 1, 300), chr(10), ' ')")} AS excerpt FROM documents"""

_KEPT = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"
DUP1_LINE_COUNTS = f"SELECT line, count(*) AS n FROM (SELECT unnest({_KEPT}) AS line FROM documents) GROUP BY line HAVING count(*) > 1"
DUP1_LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, {_KEPT} AS ls FROM documents)),
once AS (SELECT line FROM l GROUP BY line HAVING count(*) = 1), k AS (SELECT doc_id, string_agg(line, '' ORDER BY pos) AS t FROM l SEMI JOIN once USING (line) GROUP BY doc_id)
SELECT doc_id, CAST(length(u) AS INTEGER) AS n_chars, md5(u) AS text_md5 FROM (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS u FROM documents d LEFT JOIN k USING (doc_id))"""
DOC_EXACT_DEDUP = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL"

_NORM = f"""{_strip(f"regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}_\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]', '', 'g'), '{_WS}+', ' ', 'g')")}"""
_GRAMS = f"""n0 AS (SELECT {_NORM} AS norm, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1),
n1 AS (SELECT doc_id, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS w FROM n0),
g AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM n1)"""
PRJ2_NORMALIZED = f"SELECT doc_id, md5({_NORM}) AS normal_md5 FROM documents"
DUP2_SHINGLES = f"WITH {_GRAMS} SELECT doc_id, CAST(len(g) AS INTEGER) AS n_shingles FROM g"


def _sig(s: int) -> str:
    return f"coalesce(list_min(list_transform(g, lambda x: md5('{s}-' || x))), repeat('0', 32))"


DUP4_SIGNATURES = f"WITH {_GRAMS} SELECT doc_id, {' || chr(124) || '.join(_sig(s) for s in range(4))} AS signature FROM g"
_BANDS = " UNION ALL ".join(f"SELECT doc_id, {b} AS band, s{2 * b} || '|' || s{2 * b + 1} AS key FROM s" for b in range(10))
DUP6_LSH_CANDIDATES = f"""WITH {_GRAMS}, s AS MATERIALIZED (SELECT doc_id, {', '.join(f'{_sig(i)} AS s{i}' for i in range(20))} FROM g WHERE len(g) > 0), b AS ({_BANDS})
SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id"""


def _pairs_sql(least: float = 0.8) -> str:
    return f"""e AS (SELECT doc_id, len(g) AS m, unnest(g) AS x FROM g), i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n, any_value(p.m) AS ma, any_value(q.m) AS mb FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, n / (ma + mb - n) AS similarity FROM i WHERE n / (ma + mb - n) >= {least})"""


# The documents, and each once more under another id with words at its end.
_ALTERED = "docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000 AS doc_id, text || ' with an altered end' AS text FROM documents WHERE text IS NOT NULL)"
_MORE_GRAMS = f"{_ALTERED}, {_GRAMS.replace('FROM documents', 'FROM docs')}"
_REACH = """und AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, r) AS (SELECT doc_id, doc_id FROM g UNION SELECT reach.id, und.b FROM reach JOIN und ON und.a = reach.r), cls AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id)"""


def _classes(grams: str, docs: str) -> str:
    return f"""WITH RECURSIVE {grams}, {_pairs_sql()}, {_REACH}, deg AS (SELECT a AS id, count(*) AS n FROM und GROUP BY a),
mem AS (SELECT doc_id, {_NORM} AS norm FROM {docs} WHERE text IS NOT NULL), rep AS (SELECT norm, min(doc_id) AS id FROM mem GROUP BY norm)
SELECT mem.doc_id, cls.class_id, coalesce(deg.n, 0) AS n_links FROM mem JOIN rep USING (norm) JOIN cls ON cls.id = rep.id LEFT JOIN deg ON deg.id = rep.id"""


DUP7_SIMILAR_PAIRS = f"WITH {_GRAMS}, {_pairs_sql()} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"
DUP7_ALTERED_PAIRS = f"WITH {_MORE_GRAMS}, {_pairs_sql()} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"
DUP8_COMPONENTS = f"WITH RECURSIVE {_MORE_GRAMS}, {_pairs_sql()}, {_REACH} SELECT id, class_id AS component FROM cls"
DUP10_NEAR_DUPLICATES = _classes(_GRAMS, "documents")
DUP10_ALTERED_DUPLICATES = _classes(_MORE_GRAMS, "docs")
DUP10_MINHASH_CLASSES = f"""WITH RECURSIVE {_MORE_GRAMS}, s AS MATERIALIZED (SELECT doc_id, {', '.join(f'{_sig(i)} AS s{i}' for i in range(20))} FROM g WHERE len(g) > 0), b AS ({_BANDS}),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
pairs AS (SELECT a, cand.b FROM cand JOIN g p ON p.doc_id = a JOIN g q ON q.doc_id = cand.b WHERE len(list_intersect(p.g, q.g)) / len(list_distinct(list_concat(p.g, q.g))) >= 0.8), {_REACH} SELECT id, class_id AS component FROM cls"""

_TAG = r"regexp_replace(CASE WHEN instr(response, '<answer>') = 0 THEN '' ELSE split_part(substr(response, instr(response, '<answer>') + 8), '</answer>', 1) END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_EXACT = rf"(contains(response, '<answer>') AND contains(response, '</answer>') AND {_TAG} = regexp_replace(ground_truth, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
GRD5_TAG_ANSWERS = f"SELECT example_id, CASE WHEN response IS NOT NULL THEN {_TAG} END AS answer, coalesce({_EXACT}, false) AS exact FROM sft_example"
FLT12_EXACT_ANSWERS = f"SELECT example_id, ground_truth FROM sft_example WHERE {_EXACT}"


def _final() -> str:
    s = "answer"
    for a, b in SUBSTITUTIONS:
        s = f"replace({s}, {_q(a)}, {_q(b)})"
    for a in REMOVED:
        s = f"replace({s}, {_q(a)}, '')"
    for a, b in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")):
        s = f"regexp_replace({s}, {_q(a)}, {_q(b)}, 'g')"
    return f"replace({s}, '$', '')"


GRD8_FINAL_FORMS = f"SELECT problem_id, CASE WHEN regexp_matches(replace(f, ',', ''), '^[0-9]+$') THEN replace(f, ',', '') ELSE f END AS final FROM (SELECT problem_id, {_final()} AS f FROM math_problem WHERE answer IS NOT NULL)"
_NO_COMMAS = r"regexp_replace(regexp_replace(answer, '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g')"
GRD9_NUMBER_FORMS = f"""WITH a AS (SELECT problem_id, answer, {_NO_COMMAS} AS no_commas FROM math_problem)
SELECT problem_id, try_cast(answer AS DOUBLE) IS NOT NULL AS is_float, coalesce(abs(try_cast(no_commas AS DOUBLE) - round(try_cast(no_commas AS DOUBLE))) <= 1e-7, false) AS is_int,
regexp_matches(answer, '^-?[0-9]+.?/0*[1-9][0-9]*.?$') AS is_frac, no_commas, 1 AS n_elements FROM a WHERE answer IS NOT NULL
UNION ALL SELECT problem_id, NULL, NULL, NULL, NULL, NULL FROM a WHERE answer IS NULL"""


def _frac_as(c: str, to: str) -> str:
    return f"regexp_replace({c}, '[dt]?frac[{{]([^{{}}]*)[}}][{{]([^{{}}]*)[}}]', {_q(to)}, 'g')"


def _mathd(c: str) -> str:
    """The first normal form of answers as the tables hold them: numbers, fractions and boxes, no units and no letters."""
    s = f"replace(replace({_frac_as(_strip(c), 'frac{' + chr(92) + '1}{' + chr(92) + '2}')}, {_q(chr(92) + '$')}, ''), ' ', '')"
    return f"(CASE WHEN {s} = '0.5' THEN {_q(chr(92) + 'frac{1}{2}')} ELSE regexp_replace({s}, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', {_q(chr(92) * 2 + 'frac{' + chr(92) + '1}{' + chr(92) + '2}')}) END)"


def _plain(c: str) -> str:
    """The second, of the same answers."""
    s = _frac_as(f"replace(replace({c}, '$', ''), {_q(chr(92))}, '')", r"\1/\2")
    s = f"lower(replace(replace(replace(replace({s}, 'boxed', ''), ' ', ''), '{{', ''), '}}', ''))"
    bare = rf"regexp_replace(regexp_replace({s}, '([0-9]),([0-9]{{3}})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{{3}})($|[^0-9])', '\1\2\3', 'g')"
    return f"(CASE WHEN regexp_matches({bare}, '^-?[0-9]+([.]0*)?$') THEN CAST(CAST(try_cast({bare} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {s} END)"


def _boxed(c: str) -> str:
    return f"nullif(regexp_extract({c}, 'boxed[{{]((?:[^{{}}]|[{{][^{{}}]*[}}])*)[}}]', 1), '')"


GRD6_GRD7_NORMAL_FORMS = f"SELECT problem_id, {_mathd('answer')} AS mathd, {_plain('answer')} AS plain, {_boxed('answer')} AS boxed FROM math_problem"


def _value(c: str) -> str:
    return f"coalesce(try_cast({c} AS DOUBLE), try_cast(split_part({c}, '/', 1) AS DOUBLE) / nullif(try_cast(split_part({c}, '/', 2) AS DOUBLE), 0))"


_INT, _RATIO = "'^-?[0-9]+$'", "'^-?[0-9]+/0*[1-9][0-9]*$'"
_GRADED = f"""f AS (SELECT example_id, {_mathd('given')} = {_mathd('truth')} AS same, {_plain('given')} AS g, {_plain('truth')} AS t FROM e),
graded AS (SELECT example_id, coalesce(same OR g = t OR (regexp_matches(g, {_INT}) = regexp_matches(t, {_INT}) AND NOT (regexp_matches(g, {_RATIO}) AND regexp_matches(t, {_RATIO}))
  AND regexp_matches(g, '^[0-9./-]+$') AND regexp_matches(t, '^[0-9./-]+$') AND abs({_value('g')} - {_value('t')}) < 1e-12), false) AS ok FROM f)"""
_TRUTH = f"CASE WHEN contains(ground_truth, 'boxed') THEN {_boxed('ground_truth')} ELSE ground_truth END AS truth"
_LAST = "replace(list_last(string_split(response, '<answer>')), '</answer>', '')"
_REWARD = "CASE WHEN coalesce(ok, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_TAGGED = f"""s AS (SELECT example_id, response, ground_truth, coalesce(contains(response, '</think> <answer>') AND contains(response, '</answer>'), false) AS formed FROM sft_example WHERE ground_truth IS NOT NULL),
e AS (SELECT example_id, CASE WHEN contains({_LAST}, 'boxed') THEN {_boxed(_LAST)} ELSE {_LAST} END AS given, {_TRUTH} FROM s WHERE formed), {_GRADED},
rewards AS (SELECT example_id, CAST(CAST(formed AS INTEGER) AS DOUBLE) AS format_reward, {_REWARD} AS answer_reward, {_REWARD} AS reward FROM s LEFT JOIN graded USING (example_id))"""
GRD1_TAGGED_REWARDS = f"WITH {_TAGGED} SELECT * FROM rewards"
AGG2_EVAL_SUMMARY = f"WITH {_TAGGED} SELECT count(*) AS total, CAST(sum(CAST(answer_reward >= 1 AS INTEGER)) AS BIGINT) AS correct, round(avg(answer_reward), 6) AS accuracy, round(avg(reward), 6) AS mean_reward, round(avg(format_reward), 6) AS mean_format FROM rewards"
GRD2_BOXED_REWARDS = f"""WITH s AS (SELECT example_id, ground_truth, {_boxed('response')} AS given FROM sft_example WHERE ground_truth IS NOT NULL), e AS (SELECT example_id, given, {_TRUTH} FROM s WHERE given IS NOT NULL), {_GRADED}
SELECT example_id, CASE WHEN given IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS format_reward, {_REWARD} AS answer_reward, {_REWARD} AS reward FROM s LEFT JOIN graded USING (example_id)"""
# Halved steps of the search for the longest common prefix.
_STEPS = (2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def _repetitive() -> str:
    """Sums of the common prefixes of neighbouring suffixes in order, of texts of up to 4095 signs."""
    out, last = [], "q"
    for k in _STEPS:
        agree = f"substr(t, c + 1, {k}) = substr(b, c + 1, {k}) AND length(t) >= c + {k} AND length(b) >= c + {k}"
        out.append(f"l{k} AS (SELECT example_id, t, b, CAST(c + CASE WHEN {agree} THEN {k} ELSE 0 END AS BIGINT) AS c FROM {last})")
        last = f"l{k}"
    return f"""WITH x AS (SELECT example_id, response AS s, length(response) AS n FROM sft_example), p AS (SELECT example_id, substr(s, unnest(range(1, n + 1))) AS t FROM x WHERE n > 1),
q AS (SELECT example_id, t, lag(t) OVER (PARTITION BY example_id ORDER BY t) AS b, CAST(0 AS BIGINT) AS c FROM p), {', '.join(out)},
z AS (SELECT example_id, sum(c) AS common FROM {last} WHERE b IS NOT NULL GROUP BY example_id)
SELECT x.example_id, CASE WHEN s IS NOT NULL THEN coalesce(2.0 * common / (n * (n + 1)) > 0.2, false) END AS repetitive FROM x LEFT JOIN z USING (example_id)"""


GRD15_REPETITION = _repetitive()

# A blank run before a word ends one sign early: the last sign goes with the word or stands alone.
_B = r"\t\n\x0B\f\r "
_PIECES = rf"string_split(regexp_replace(piece, '([{_B}])([{_B}][^{_B}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))"
_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _B + r"\p{L}\p{N}]+|[" + _B + "]+"
_PRETOKENS = f"""sp AS (SELECT unnest(string_split(text, '<|endoftext|>')) AS piece FROM documents), pc AS (SELECT unnest({_PIECES}) AS piece FROM sp),
tk AS (SELECT unnest(regexp_extract_all(piece, {_q(_TOKEN)})) AS tok FROM pc), cnt AS (SELECT tok, count(*) AS n FROM tk GROUP BY tok)"""
_BYTE_PAIRS = 'hx AS (SELECT hex(encode(tok)) AS h, n FROM cnt), pos AS (SELECT h, n, unnest(range(1, CAST(length(h) / 2 AS BIGINT))) AS i FROM hx), bp AS (SELECT substr(h, CAST(2 * i - 1 AS INTEGER), 2) AS "left", substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS "right", CAST(sum(n) AS BIGINT) AS n FROM pos GROUP BY 1, 2)'
BPE4_PRETOKEN_COUNTS = f"WITH {_PRETOKENS} SELECT tok, n FROM cnt"
BPE5_PAIR_COUNTS = f'WITH {_PRETOKENS}, {_BYTE_PAIRS} SELECT "left", "right", n FROM bp'
BPE6_BEST_PAIR = f'WITH {_PRETOKENS}, {_BYTE_PAIRS} SELECT "left", "right", n FROM bp ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1'
_CODES = "CASE WHEN {0} = '' THEN []::INTEGER[] ELSE list_transform(string_split({0}, ''), lambda c: unicode(c)) END"
SMP6_PROMPT_RESPONSE = f"""WITH a AS (SELECT example_id, {_CODES.format('prompt')} AS p, {_CODES.format('response')} AS r FROM sft_example WHERE prompt IS NOT NULL AND response IS NOT NULL), b AS (SELECT *, len(p) + len(r) AS n FROM a)
SELECT example_id, CAST(greatest(n - 1, 0) AS INTEGER) AS n_input, CAST(CASE WHEN len(p) > 0 THEN len(r) ELSE greatest(len(r) - 1, 0) END AS INTEGER) AS n_response, CAST(coalesce(list_sum(list_concat(p, r)[2:]), 0) AS BIGINT) AS label_sum,
CAST(coalesce(CASE WHEN len(p) > 0 THEN list_sum(r) ELSE list_sum(r[2:]) END, 0) AS BIGINT) AS response_label_sum FROM b"""

_U = "u AS (SELECT DISTINCT ON (rollout_id) * FROM rollout)"
_G = "PARTITION BY run_id, step, prompt_id"
WIN1_GROUP_ADVANTAGES = f"WITH {_U} SELECT rollout_id, round(reward - avg(reward) OVER ({_G}), 6) AS centred, round((reward - avg(reward) OVER ({_G})) / (stddev_samp(reward) OVER ({_G}) + 1e-6), 6) AS group_advantage FROM u"
AGG8_REWARD_METADATA = f"""WITH {_U}, a AS (SELECT *, avg(reward) OVER ({_G}) AS m, stddev_samp(reward) OVER ({_G}) AS s FROM u WHERE reward IS NOT NULL), b AS (SELECT *, (reward - m) / (s + 1e-6) AS adv FROM a),
p AS (SELECT avg(reward) AS m, stddev_samp(reward) AS s FROM a GROUP BY run_id, step, prompt_id)
SELECT round(avg(reward), 6) AS mean_reward, round(stddev_samp(reward), 6) AS std_reward, min(reward) AS min_reward, max(reward) AS max_reward, abs(round(avg(adv), 6)) AS mean_advantage, round(stddev_samp(adv), 6) AS std_advantage,
(SELECT round(avg(m), 6) FROM p) AS mean_group_mean, (SELECT round(avg(s), 6) FROM p) AS mean_group_std, (SELECT round(min(s), 6) FROM p) AS min_group_std, (SELECT round(max(s), 6) FROM p) AS max_group_std FROM b"""
AGG3_VALIDATION_MEANS = f"WITH {_TAGGED} SELECT round(avg(CAST(reward > 0 AS INTEGER)), 6) AS accuracy, round(avg(reward), 6) AS mean_reward, round(avg(format_reward), 6) AS mean_format, round(avg(answer_reward), 6) AS mean_answer FROM rewards"
AGG3_RUN_MEANS = f"WITH {_U} SELECT run_id, count(*) AS n, round(avg(CAST(reward > 0 AS INTEGER)), 6) AS accuracy, round(avg(reward), 6) AS mean_reward FROM u GROUP BY run_id"
AGG4_SUCCESS_RATE = f"WITH {_U} SELECT run_id, count(*) AS n_generated, CAST(coalesce(sum(CAST(reward > 0 AS INTEGER)), 0) AS BIGINT) AS n_kept, round(avg(length(response) / 100), 6) AS mean_entropy, round(coalesce(sum(CAST(reward > 0 AS INTEGER)), 0) / count(*), 6) AS success_rate FROM u GROUP BY run_id"
AGG5_LENGTH_SUMMARY = f"WITH {_U}, v AS (SELECT *, coalesce(reward > 0, false) AS ok FROM u) SELECT run_id, round(coalesce(avg(length(response)), 0), 6) AS mean_length, round(coalesce(avg(length(response)) FILTER (ok), 0), 6) AS mean_length_correct, round(coalesce(avg(length(response)) FILTER (NOT ok), 0), 6) AS mean_length_incorrect FROM v GROUP BY run_id"
FLT11_KEPT_ROLLOUTS = "SELECT DISTINCT rollout_id FROM rollout WHERE reward > 0"
AGG9_TIMING = "SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY event_type"
AGG10_AGG11_SHARES = "SELECT l_returnflag, round(CAST(sum(l_discount) AS DOUBLE) / CAST(sum(l_quantity) AS DOUBLE) * 100, 6) AS share, round(CAST(sum(l_quantity) AS DOUBLE) / CAST(sum(l_discount) AS DOUBLE), 4) AS speed_up, true AS is_nan FROM lineitem GROUP BY l_returnflag"
SRT2_BEST_ROLLOUT = f"WITH {_U} SELECT run_id, arg_max(rollout_id, (reward, -rollout_id)) AS best, max(reward) AS reward FROM u WHERE reward IS NOT NULL GROUP BY run_id"

_ARR = "arr AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label - 4.5 AS adv FROM embeddings), el AS (SELECT vec_id, label, adv, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM arr)"
AGG12_MASKED_MEANS = f"WITH {_ARR} SELECT vec_id, round(coalesce(avg(v) FILTER (v > 0), 'nan'::DOUBLE), 6) AS masked_mean, round(coalesce(sum(v) FILTER (v > 0), 0) / 10.0, 6) AS normalized FROM el GROUP BY vec_id"
_CLIP = "greatest(least(exp(v - v * 0.9), 1.05), 0.95) * adv"
RLN2_CLIP_LOSS = f"WITH {_ARR} SELECT vec_id, round(avg(-least(exp(v - v * 0.9) * adv, {_CLIP})) FILTER (v > 0), 6) AS loss, CAST(count_if({_CLIP} < exp(v - v * 0.9) * adv) AS INTEGER) AS n_clipped, round(avg(-adv * v) FILTER (v > 0), 6) AS naive FROM el GROUP BY vec_id"
RLN2_CLIP_METADATA = f"""WITH {_ARR}, r AS (SELECT v - v * 0.9 AS l, exp(v - v * 0.9) AS ratio, {_CLIP} < exp(v - v * 0.9) * adv AS clipped FROM el)
SELECT round(avg(CAST(clipped AS INTEGER)), 6) AS clipped_fraction, round(avg(ratio), 6) AS ratio_mean, round(stddev_samp(ratio), 6) AS ratio_std, round(min(ratio), 6) AS ratio_min, round(max(ratio), 6) AS ratio_max, round(avg(l), 6) AS log_ratio_mean, round(stddev_samp(l), 6) AS log_ratio_std FROM r"""
RLN4_MICROBATCH = f"WITH {_ARR}, m AS (SELECT avg(-adv * v) FILTER (v > 0) AS l FROM el GROUP BY vec_id) SELECT round(avg(l), 6) AS batch_loss, round(avg(l) / 4, 6) AS scaled_loss FROM m"
RLN5_SFT_LOSS = f"WITH {_ARR} SELECT round(-sum(v) FILTER (v > 0) / 2.0 / count(DISTINCT vec_id) / 4, 6) AS loss FROM el"
RLN6_LOG_SOFTMAX = f"""WITH {_ARR}, z AS (SELECT vec_id, any_value(label) AS label, max(v) AS m, ln(sum(exp(v))) AS z, avg(v) AS a FROM el GROUP BY vec_id)
SELECT vec_id, round(max(CASE WHEN i = z.label + 1 THEN v END) - any_value(z), 6) AS log_softmax, round(-sum(exp(v - z) * (v - z)), 6) AS entropy, round(-any_value(a), 6) AS chosen_entropy, round(exp(any_value(m) - any_value(z)), 6) AS top_p FROM el JOIN z USING (vec_id) GROUP BY vec_id"""
RLN7_LEARNING_RATE = "SELECT run_id, CAST(step AS INTEGER) AS step, round(CASE WHEN step < 10 THEN step / 10 * 1.0 WHEN step < 100 THEN 0.1 + 0.5 * (1 + cos((step - 10) / 90 * pi())) * 0.9 ELSE 0.1 END, 6) AS factor FROM grpo_run, range(0, 120, 5) t(step)"
RLN9_ATTENTION = "SELECT label, round(sum(exp(CAST(embedding[1] AS DOUBLE)) * CAST(embedding[2] AS DOUBLE)) / sum(exp(CAST(embedding[1] AS DOUBLE))), 6) AS attended, round(ln(sum(exp(CAST(embedding[1] AS DOUBLE)))), 6) AS log_sum_exp FROM embeddings GROUP BY label"
WIN3_TOP_P = """WITH n AS (SELECT lang, coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM n),
c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY p DESC, source ROWS UNBOUNDED PRECEDING) AS c FROM p), k AS (SELECT * FROM c WHERE c - p <= 0.5) SELECT lang, source, n, round(p / sum(p) OVER (PARTITION BY lang), 6) AS renormalized FROM k"""
SMP7_COLLATE = f"WITH a AS (SELECT example_id, CAST(floor(example_id / 8) AS BIGINT) AS batch, {_words('response')} AS w FROM sft_example WHERE response IS NOT NULL) SELECT example_id, batch, CAST(max(len(w)) OVER (PARTITION BY batch) AS INTEGER) AS padded, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS INTEGER) AS total FROM a"
SMP5_WINDOWS = f"""WITH a AS (SELECT doc_id, list_transform({_words('text')}, lambda x: length(x)) AS ids FROM documents WHERE text IS NOT NULL), b AS (SELECT *, unnest([0, 1]) AS win FROM a WHERE len(ids) > 16),
c AS (SELECT *, CAST(CAST('0x' || substr(md5('0-' || doc_id || '-' || win), 1, 8) AS BIGINT) % (len(ids) - 16) AS INTEGER) AS start FROM b)
SELECT doc_id, win AS "window", start, CAST(list_sum(ids[start+1:start+16]) AS INTEGER) AS inputs, CAST(list_sum(ids[start+2:start+17]) AS INTEGER) AS targets FROM c"""
SMP1_SAMPLE_K = "SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 10"
SMP8_BATCHES = "SELECT problem_id, row_number() OVER (ORDER BY problem_id) - 1 AS row, CAST(floor((row_number() OVER (ORDER BY problem_id) - 1) / 64) AS BIGINT) AS batch FROM math_problem"
SMP9_ROLLOUT_PLAN = "SELECT problem_id, md5('Q: ' || problem || chr(10) || 'A:') AS prompt_md5, CAST(r AS INTEGER) AS rollout FROM math_problem, range(0, 8) t(r) WHERE split = 'test' AND problem IS NOT NULL"
JOI1_URI_MATCH = "SELECT w.record_id, m.warc_id FROM wet_record w JOIN (SELECT target_uri, min(record_id) AS warc_id FROM warc_record WHERE warc_type = 'response' GROUP BY target_uri) m USING (target_uri)"
JOI1_FIRST_ROLLOUT = "SELECT problem_id, first_rollout FROM math_problem JOIN (SELECT prompt_id AS problem_id, min(rollout_id) AS first_rollout FROM rollout GROUP BY 1) USING (problem_id)"
JOI4_JOI8_MEMBERSHIP = "SELECT problem_id, problem_id IN (SELECT prompt_id FROM rollout WHERE prompt_id IS NOT NULL) AS answered FROM math_problem"
JOI6_PROMPT_OUTPUT = f"WITH {_U} SELECT rollout_id, true_answer IS NOT DISTINCT FROM answer AS same_answer FROM u JOIN math_problem p ON p.problem_id = u.prompt_id"
JOI7_STATE_DIFFERENCE = "SELECT o_orderkey, round(a, 2) AS a, round(b, 2) AS b FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS a FROM orders) FULL JOIN (SELECT l_orderkey AS o_orderkey, CAST(sum(l_extendedprice) AS DOUBLE) AS b FROM lineitem GROUP BY 1) USING (o_orderkey) WHERE a IS NULL OR b IS NULL OR abs(a - b) > 0.01"
SET1_SHARED_WORDS = f"""WITH a AS (SELECT example_id, list_distinct({_words('prompt')}) AS p, list_distinct({_words('response')}) AS r FROM sft_example WHERE prompt IS NOT NULL AND response IS NOT NULL),
b AS (SELECT example_id, CAST(len(list_intersect(p, r)) AS INTEGER) AS n_both, CAST(len(list_distinct(list_concat(p, r))) AS INTEGER) AS n_any FROM a) SELECT example_id, n_both, n_any, round(CASE WHEN n_any = 0 THEN 0.0 ELSE n_both / n_any END, 6) AS jaccard FROM b"""
AGG6_ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("documents", "warc_record", "wet_record", "math_problem", "sft_example", "rollout", "eval_item", "labelled_line"))
SNK2_LABEL_LINES = f"""SELECT line_id, CASE WHEN label = '__label__clean' THEN '__label__positive ' || {_strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} ELSE '__label__negative ' || {_strip("replace(text, chr(10), ' ')")} END AS line FROM labelled_line"""
