"""The registered queries in DuckDB SQL, written independently of the Spark code.

Word lists, thresholds and dates come from the same constants; everything else
is stated here a second time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from newsignal.functions import text
from newsignal.operators import cleaning, indicators, lexicon, mentions
from newsignal.plans import catalog, tables


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def rows(values) -> str:
    return ", ".join("(" + ", ".join(v if v[0] in "-0123456789" else quoted(v) for v in row) + ")" for row in values)


def any_contains(column: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
STRIP = f"^{SPACE}+|{SPACE}+$"

ARTICLE_DATE = f"(date '{tables.FIRST_DAY}' + cast(doc_id % 30 as integer))"

ARTICLES = f"articles as (select doc_id, {ARTICLE_DATE} as date, text, source from documents)"

RAW = f"""raw as (
  select doc_id, {ARTICLE_DATE} as date,
    case when n_chars < 10 then ''
         when n_chars < 60 then 'None'
         when contains(text, 'worthless') then text || ' 403 forbidden'
         when lang = 'fr' then chr(160) || chr(9) || text || chr(8195) || chr(10)
         else text end as text
  from documents)"""

CLEAN = f"""{RAW},
kept as (
  select doc_id, date, text,
    regexp_replace(substr(text, 1, 10000), {quoted(STRIP)}, '', 'g') as trimmed_text
  from raw where text is not null and text not in ('', 'None') and date is not null
    and not contains(text, 'forbidden') and regexp_replace(text, {quoted(STRIP)}, '', 'g') <> ''),
cleaned as (
  select min(doc_id) as doc_id, date, 0 as exception_flag, text, trimmed_text
  from kept group by date, text, trimmed_text)"""


# Stated here a second time, not taken from the code under test.
WORD_CUT = quoted(r"[^\p{L}']+")
SHOUTED = quoted(r"^\p{Lu}{2,}$")


def polarity_ctes(
    source: str = "articles", r: lexicon.Rules = tables.CORPUS_RULES,
    entries: Mapping[str, float] = lexicon.DEFAULT_VALENCES, tokens: str | None = None,
) -> str:
    """tokens -> hits -> polarity(doc_id, date, lexicon_polarity); `tokens` is a list expression on the text."""
    valences = rows((t, repr(float(v))) for t, v in entries.items())
    words = lambda body: f"[x for x in string_split_regex({body}, {WORD_CUT}) if x <> '']"
    small = f"list_transform({tokens}, lambda x: lower(x))" if tokens else words("lower(text)")
    shout = lambda raw: f"regexp_matches(replace({raw}, ' ', ''), {SHOUTED})"

    def value(capitals: bool) -> str:
        loud = lambda k: f"(case when coalesce(loud{k}, false) then {r.capitals} else 0 end)" if capitals else "0"
        out = f"(cast(valence as double) + sign(valence) * {loud(0)})"
        for k in (1, 2, 3):
            nudge = (
                f"(case when back{k} in ({listed(r.stronger)}) then cast({r.boost} as double) + {loud(k)}"
                f" when back{k} in ({listed(r.weaker)}) then -(cast({r.boost} as double) + {loud(k)}) else 0 end)"
            )
            out = f"({out} + sign(valence) * {nudge} * cast({r.fade[k - 1]} as double))"
            out = f"({out} * (case when back{k} in ({listed(r.negations)}) then cast({r.negate} as double) else 1 end))"
        return (
            f"cast(round({out} * (case when turn = 0 or place = turn then 1 when place < turn"
            f" then cast({r.before_contrast} as double) else cast({r.after_contrast} as double) end) * 1e6) as bigint)"
        )

    return f"""split_up as (
  select doc_id, date, {tokens or words("text")} as t, coalesce(list_position({small}, {quoted(r.contrast)}), 0) as turn,
    length(text) - length(replace(text, '!', '')) as bang,
    length(text) - length(replace(text, '?', '')) as ask
  from {source}),
single as (select doc_id, turn, unnest(t) as raw, generate_subscripts(t, 1) as place from split_up),
backed as (
  select doc_id, turn, place, lower(raw) as word, raw,
    lower(lag(raw, 1) over w) as back1, lower(lag(raw, 2) over w) as back2, lower(lag(raw, 3) over w) as back3,
    {shout("raw")} as loud0, {shout("lag(raw, 1) over w")} as loud1,
    {shout("lag(raw, 2) over w")} as loud2, {shout("lag(raw, 3) over w")} as loud3
  from single window w as (partition by doc_id order by place)),
lex(word, valence) as (values {valences}),
sums as (
  select doc_id, sum({value(False)}) as plain, sum({value(True)}) as capital
  from backed join lex using (word) group by doc_id),
loudness as (select doc_id, count_if(loud0) as loud, count(*) as n from backed group by doc_id),
totals as (
  select s.doc_id, s.date, bang, ask,
    coalesce(case when loud > 0 and loud < n then capital else plain end, 0) / 1e6 as total
  from split_up s left join sums using (doc_id) left join loudness using (doc_id)),
marked as (
  select doc_id, date, total + sign(total) * (least(bang, {r.most_exclamations}) * {r.exclamation}
    + case when ask > 3 then {r.many_questions} when ask > 1 then ask * {r.question} else 0 end) as s
  from totals),
polarity as (select doc_id, date, s / sqrt(s * s + {r.alpha}) as lexicon_polarity from marked)"""


POLARITY = f"{ARTICLES}, {polarity_ctes()}"


def phrase_tokens() -> str:
    """Pieces between white space, cut into words unless they are symbols; then phrases, longest first."""
    marks = "'|', ':)'"
    piece = f"""case when p in ({marks}) then [p] when regexp_replace(p, '[.,!?]+$', '') in ({marks}) then [regexp_replace(p, '[.,!?]+$', '')]
    else [x for x in string_split_regex(p, {WORD_CUT}) if x <> ''] end"""
    joined = f"array_to_string(flatten(list_transform(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda p: {piece})), ' ')"
    known = [*tables.CORPUS_ENTRIES, *tables.PHRASE_ROLES.negations, *tables.PHRASE_ROLES.stronger, *tables.PHRASE_ROLES.weaker]
    longest = sorted((e for e in known if " " in e), key=len, reverse=True)
    return f"regexp_extract_all({joined}, '(?i)({'|'.join(longest)}|[^ ]+)(?: |$)', 1)"


SMILING = f"""smiling as (select doc_id, date, replace(text, '.' || chr(10), ' :).' || chr(10)) as text from articles)"""

PHRASED = f"{ARTICLES}, {SMILING}, {polarity_ctes('smiling', tables.PHRASE_ROLES, tables.CORPUS_ENTRIES, phrase_tokens())}"

CLASS5 = """case when lexicon_polarity < -0.5 then 'Very_Negative' when lexicon_polarity < 0 then 'Slight_Negative'
  when lexicon_polarity = 0 then 'Neutral' when lexicon_polarity <= 0.5 then 'Slight_Positive' else 'Very_Positive' end"""

DAILY = "daily as (select date, avg(lexicon_polarity) as mean_polarity from polarity group by date)"

def keyword_ctes(name: str, body: str, source: str = "articles") -> str:
    """Table `name` (doc_id, date, label, score) of the keyword balance of an expression on the text."""
    up, down = (quoted("|".join(k)) for k in (tables.KEYWORDS_UP, tables.KEYWORDS_DOWN))
    return f"""{name}_hits as (
  select doc_id, date, len(regexp_extract_all(lower({body}), {up})) as up,
    len(regexp_extract_all(lower({body}), {down})) as down
  from {source}),
{name} as (
  select doc_id, date,
    case when up > down then 'POSITIVE' when up < down then 'NEGATIVE' else 'UNKNOWN' end as label,
    case when up <> down then abs(cast(up - down as double) / (up + down)) else 0.0 end as score
  from {name}_hits)"""


KEYWORDS = f"{ARTICLES}, {keyword_ctes('keyword', 'text')}"

BEGINNING = f"array_to_string(list_filter(string_split_regex(text, {quoted(SPACE + '+')}), lambda w: w <> '')[1:{catalog.HEADLINE_WORDS}], ' ')"

SCORED_TWICE = f"{keyword_ctes('keywords', 'text')}, {keyword_ctes('headlines', BEGINNING)}"

LONG = f"""{POLARITY}, {DAILY},
wide as (
  select doc_id, date, {CLASS5} as polarity_class,
    cast(cast(lexicon_polarity as decimal(12,4)) as varchar) as lexicon_polarity,
    cast(cast(mean_polarity as decimal(12,4)) as varchar) as mean_polarity
  from polarity join daily using (date)),
long as (
  select doc_id, date, 'lexicon_polarity' as sentiment_type, lexicon_polarity as value from wide
  union all select doc_id, date, 'mean_polarity', mean_polarity from wide
  union all select doc_id, date, 'polarity_class', polarity_class from wide)"""



def finance_long() -> str:
    numbers = ("lexicon_polarity", "mean_polarity", "keywords_score", "headlines_score")
    values = [(n, f"round({n}, 6)", "null") for n in numbers]
    values += [(n, "null", n) for n in ("polarity_class", "keywords_label", "headlines_label")]
    parts = " union all ".join(
        f"select doc_id, date, exception_flag, finance_flag, '{n}' as sentiment_type, cast({number} as double) as number, cast({word} as varchar) as word from wide"
        for n, number, word in values
    )
    return f"""with {CLEAN}, {polarity_ctes("cleaned")}, {DAILY},
{keyword_ctes("keywords", "text", "cleaned")}, {keyword_ctes("headlines", BEGINNING, "cleaned")},
wide as (
  select doc_id, date, exception_flag, 1 as finance_flag, lexicon_polarity, mean_polarity, {CLASS5} as polarity_class,
    k.label as keywords_label, k.score as keywords_score, h.label as headlines_label, h.score as headlines_score
  from cleaned join polarity using (doc_id, date) join daily using (date)
    join keywords k using (doc_id, date) join headlines h using (doc_id, date)
  where {any_contains("lower(text)", [t.lower() for t in catalog.FLAG_TERMS])})
{parts}"""


TOKENS = r"""single as (
  select doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from (
    select doc_id, [x for x in string_split_regex(lower(text), '[^\p{L}]+') if x <> ''] as t from documents)),
vocab as (
  select term, count(*) as n, row_number() over (order by count(*) desc, term) - 1 as token_id
  from single group by term)"""


def mention_sql() -> str:
    terms = [*tables.CORPUS_TERMS, *[(t, e, "generic") for t, e in mentions.GENERIC_TERMS.items()]]
    cut = quoted(text.WORD_BREAK)
    longest = 3
    phrases = " union all ".join(
        f"select doc_id, array_to_string(t[i:i+{n - 1}], ' ') as phrase from spots where i + {n - 1} <= len(t)"
        for n in range(1, longest + 1)
    )
    return f"""with doc as (
  select doc_id, [x for x in string_split_regex(text, {cut}) if x <> ''] as t from documents),
spots as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from doc),
phrases as ({phrases}),
counted as (select doc_id, phrase, count(*) as c from phrases group by all),
terms(term, entity, kind) as (values {rows(terms)}),
dict as (
  select entity, kind, array_to_string([x for x in string_split_regex(term, {cut}) if x <> ''], ' ') as phrase from terms)
select doc_id, entity, cast(sum(c) as bigint) as mentions
from counted join dict on case when kind = 'ticker' then counted.phrase = dict.phrase
  else lower(counted.phrase) = lower(dict.phrase) end
group by doc_id, entity"""


# Page patterns and references of the given pages, stated a second time.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
PARAGRAPH_OPEN = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = r"(?is)</p\s*>.*|</(?:body|html|article|div|footer)\s*>.*"
MARKUP = r"(?s)<[^>]*>"
LIST_LINK = r"(?is)<li\b[^>]*>\s*<a\b[^>]*>.*?</a>"
ADDRESS = r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
)


def decoded(expression: str) -> str:
    for name, character in ENTITIES:
        expression = f"replace({expression}, {quoted(name)}, {quoted(character)})"
    return expression


def visible(expression: str) -> str:
    inner = decoded(f"regexp_replace({expression}, {quoted(MARKUP)}, '', 'g')")
    return f"regexp_replace({inner}, {quoted(STRIP)}, '', 'g')"


SHOWN = f"shown as (select page_id, regexp_replace(html, {quoted(HIDDEN)}, '', 'g') as html from pages)"

PARAGRAPHS = f"""{SHOWN},
pieces as (
  select page_id, unnest(p) as piece, generate_subscripts(p, 1) as i from (
    select page_id, string_split_regex(html, {quoted(PARAGRAPH_OPEN)}) as p from shown)),
paragraphs as (
  select page_id, i - 2 as pos,
    {visible(f"regexp_replace(piece, {quoted(PARAGRAPH_END)}, '')")} as text
  from pieces where i >= 2)"""

BARS = """bars as (
  select p_brand as ticker, cast(l_shipdate as date) as date,
    max(l_extendedprice) as high, min(l_extendedprice) as low,
    floor(cast(sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as double) / (count(*) * 100)) as close,
    cast(sum(l_quantity) as bigint) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

EVENT_BARS = """event_bars as (
  select event_type as ticker, cast(ts as date) as date, arg_min(value, ts) as open, max(value) as high,
    min(value) as low, arg_max(value, ts) as close, count(*) as volume
  from events group by 1, 2),
labelled as (
  select ticker, date, close, case when lead(close) over (partition by ticker order by date) > close
    then 1 else 0 end as movement
  from event_bars)"""

SERIES = """series as (
  select cast(o_orderdate as date) as date,
    floor(cast(sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)) as double) / (count(*) * 100)) as value
  from orders group by 1)"""

BY = "over (partition by ticker order by date"
DAILY_RETURN = f"(close / nullif(lag(close) {BY}), 0) - 1) * 100"


def sma(n: int) -> str:
    return f"avg(close) {BY} rows between {n - 1} preceding and current row)"


def forward(k: int) -> str:
    return f"(lead(close, {k}) {BY}) - close) / nullif(close, 0) * 100"


SD = f"stddev_samp(close) {BY} rows between 19 preceding and current row)"


def ema_ctes(spans: Sequence[int] = indicators.EMA_SPANS) -> str:
    start = ", ".join(f"close as ema_{s}" for s in spans)
    step = ", ".join(
        f"(1 - 2.0::double / {s + 1}) * e.ema_{s} + (2.0::double / {s + 1}) * n.close" for s in spans
    )
    names = ", ".join(f"ema_{s}" for s in spans)
    return f"""numbered as (select *, row_number() {BY}) as rn from bars),
ema(ticker, date, rn, {names}) as (
  select ticker, date, rn, {start} from numbered where rn = 1
  union all
  select n.ticker, n.date, n.rn, {step} from ema e join numbered n on n.ticker = e.ticker and n.rn = e.rn + 1)"""


STEPS = f"""steps as (
  select *, row_number() {BY}) as rn, coalesce(close - lag(close) {BY}), 0) as d from bars),
sides as (
  select *, avg(greatest(d, 0)) {BY} rows between 13 preceding and current row) as gain,
    avg(greatest(-d, 0)) {BY} rows between 13 preceding and current row) as loss
  from steps)"""
RSI = "case when rn < 14 then null when loss > 0 then 100 - 100 / (1 + gain / loss) when gain > 0 then 100.0 end"
OBV = f"cast(sum(sign(d) * volume) {BY}) as bigint)"

SPLIT = "substr(md5({}), 1, 2) < '33'"
BAR_SPLIT = SPLIT.format("ticker || '|' || strftime(date, '%Y-%m-%d')")

SIGNED = "avg(case when label = 'NEGATIVE' then -score else score end)"
FEATURE_TABLE = f"""feature_table as materialized (
  select ticker, date, close, movement, {BAR_SPLIT} as is_test,
    mean_polarity, mean_polarity as lexicon_mean, keywords_mean, headlines_mean
  from labelled join daily using (date)
    join (select date, {SIGNED} as keywords_mean from keywords group by date) using (date)
    join (select date, {SIGNED} as headlines_mean from headlines group by date) using (date))"""


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minors = [determinant([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return "(" + " ".join(f"{'-+'[j % 2 == 0]} {m[0][j]} * {d}" for j, d in enumerate(minors)) + ")"


def svm_ctes(name: str, features: Sequence[str], source: str, steps: int = 40) -> str:
    """`<name>` (ticker, date, movement, decision): test rows; plain Newton steps, solved by Cramer's rule."""
    n = len(features) + 1
    fit = ", ".join(f"avg({f}) as m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) as s_{f}" for f in features)
    scaled = ", ".join(f"({f} - m_{f}) / s_{f} as x{i}" for i, f in enumerate(features))
    dot = " + ".join(f"w{i} * x{i}" for i in range(n))
    loss = f"1 - y * ({dot}) > 0"
    a = {(i, j): f"a{min(i, j)}{max(i, j)}" for i in range(n) for j in range(n)}
    sums = ", ".join(f"coalesce(sum(x{i} * x{j}) filter ({loss}), 0) * 2 + {int(i == j)} as a{i}{j}" for i in range(n) for j in range(i, n))
    right = ", ".join(f"coalesce(sum(y * x{i}) filter ({loss}), 0) * 2 as r{i}" for i in range(n))
    whole = determinant([[a[i, j] for j in range(n)] for i in range(n)])
    solved = ", ".join(
        determinant([[f"r{i}" if j == k else a[i, j] for j in range(n)] for i in range(n)]) + f" / {whole}" for k in range(n)
    )
    return f"""{name}_x as materialized (
  select ticker, date, movement, is_test, 2.0::double * movement - 1 as y, {scaled}, 1.0::double as x{n - 1}
  from {source}, (select {fit} from {source} where not is_test)),
{name}_w(step, {', '.join(f'w{i}' for i in range(n))}) as (
  select 0, {', '.join('0.0::double' for _ in range(n))}
  union all
  select step + 1, {solved} from (
    select step, {sums}, {right} from {name}_w, {name}_x where not is_test and step < {steps} group by step)),
{name} as (
  select ticker, date, movement, {dot} as decision from {name}_x, (select * from {name}_w where step = {steps}) where is_test)"""


def report_row(name: str, source: str) -> str:
    return f"""select {quoted(name)} as model, round(avg(case when (decision > 0) = (movement = 1) then 1.0 else 0.0 end), 6) as accuracy,
  round((sum(case when movement = 1 then mid else 0 end) - count_if(movement = 1) * (count_if(movement = 1) + 1) / 2.0)
    / (count_if(movement = 1) * count_if(movement <> 1)), 6) as auc, true as converged
from (select *, rank() over (order by decision) + (count(*) over (partition by decision) - 1) / 2.0 as mid from {source})"""


def bars_select(columns: str, ctes: str = BARS) -> str:
    return f"with {ctes} select ticker, date, {columns} from bars"


def round_all(pairs: dict[str, str], places: int) -> str:
    return ", ".join(f"round({e}, {places}) as {n}" for n, e in pairs.items())


def describe_one(column: str) -> str:
    parts = {
        "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})",
        "p25": f"quantile_cont({column}, 0.25)", "p50": f"quantile_cont({column}, 0.5)",
        "p75": f"quantile_cont({column}, 0.75)", "max": f"max({column})",
    }
    return f"select '{column}' as \"column\", count({column}) as count, {round_all(parts, 4)} from lineitem"


def edge(name: str) -> str:
    return f"date '{catalog.LINK_DATES[name]}'"


def oracle() -> dict[str, str]:
    forwards = {indicators.forward_name(k): forward(k) for k in indicators.HORIZONS}
    moves = ", ".join(
        f"case when {forward(k)} > 0 then 1 else 0 end as {indicators.movement_name(k)}"
        for k in indicators.HORIZONS
    )
    smas = {f"sma_{n}": sma(n) for n in indicators.SMA_WINDOWS}
    emas = {f"ema_{s}": f"ema_{s}" for s in indicators.EMA_SPANS}
    bands = {
        "bollinger_band_middle": sma(20), "sd": SD,
        "bollinger_band_upper": f"{sma(20)} + 2 * {SD}", "bollinger_band_lower": f"{sma(20)} - 2 * {SD}",
    }
    train_end, test_start = catalog.SPLIT_DATES
    return {
        "clean_articles": f"""with {CLEAN} select doc_id, date, exception_flag, md5(text) as text_md5,
  md5(trimmed_text) as trimmed_md5, cast(length(trimmed_text) as integer) as trimmed_length from cleaned""",
        "scored_articles": f"""with {CLEAN}, {polarity_ctes("cleaned")}, {DAILY}
select doc_id, date, exception_flag, md5(text) as text_md5, round(lexicon_polarity, 6) as lexicon_polarity,
  round(mean_polarity, 6) as mean_polarity, {CLASS5} as polarity_class,
  case when lexicon_polarity > 0 then 'positive' when lexicon_polarity < 0 then 'negative' else 'neutral' end as polarity_sign
from cleaned join polarity using (doc_id, date) join daily using (date)""",
        "dedupe_articles": "select min(doc_id) as doc_id, lang, md5(text) as text_md5 from documents group by lang, text",
        "null_profile": f"""with {RAW}, t as (select doc_id, date, case when text in ('', 'None') then null else text end as text from raw)
select count(*) as row_count, count(*) - count(doc_id) as doc_id_nulls, count(*) - count(date) as date_nulls,
  count(*) - count(text) as text_nulls from t""",
        "describe_numeric": " union all ".join(
            describe_one(c) for c in ("l_quantity", "l_extendedprice", "l_discount")
        ),
        "date_flags": f"""with t as (
  select o_orderkey, strftime(o_orderdate, '%Y%m%d') || '.daily.csv.zip' as text, cast(o_orderdate as date) as date from orders)
select *, 1 as recent, case when date >= {edge("late")} then 0 else 1 end as before_late, 1 as before_stop
from t where date >= {edge("start")} and date < {edge("stop")}""",
        "any_of_filter": f"select doc_id, source from documents where {any_contains('text', catalog.PLACES)}",
        "finance_flag": f"""select doc_id, case when {any_contains('lower(text)', [t.lower() for t in catalog.FLAG_TERMS])}
  then 1 else 0 end as finance_flag from documents""",
        "entity_mentions": mention_sql(),
        "lexicon_polarity": f"with {POLARITY} select doc_id, date, round(lexicon_polarity, 6) as lexicon_polarity from polarity",
        "phrase_polarity": f"with {PHRASED} select doc_id, date, round(lexicon_polarity, 6) as lexicon_polarity from polarity",
        "clean_daily_sentiment": f"""with {CLEAN}, {polarity_ctes("cleaned")}, {DAILY}
select date, round(mean_polarity, 6) as mean_polarity from daily""",
        "daily_sentiment": f"with {POLARITY}, {DAILY} select date, round(mean_polarity, 6) as mean_polarity from daily",
        "daily_sentiment_attach": f"""with {POLARITY} select doc_id, date, round(lexicon_polarity, 6) as lexicon_polarity,
  round(avg(lexicon_polarity) over (partition by date), 6) as mean_polarity from polarity""",
        "polarity_class5": f"with {POLARITY} select doc_id, {CLASS5} as polarity_class from polarity",
        "polarity_class3": f"""with {POLARITY} select doc_id, case when lexicon_polarity > 0 then 'positive'
  when lexicon_polarity < 0 then 'negative' else 'neutral' end as polarity_class from polarity""",
        "signed_score": f"""with {KEYWORDS} select doc_id, label,
  round(case when label = 'NEGATIVE' then -score else score end, 6) as score from keyword""",
        "score_text": f"with {KEYWORDS} select doc_id, label, round(score, 6) as score from keyword",
        "sentiment_long": f"with {LONG} select * from long",
        "finance_long": finance_long(),
        "long_type_slice": f"""with {LONG} select doc_id, date, sentiment_type, cast(value as double) as value
  from long where sentiment_type = 'lexicon_polarity'""",
        "token_ids": f"with {TOKENS} select * from vocab",
        "encode_tokens": f"with {TOKENS} select doc_id, cast(pos as integer) as pos, token_id from single join vocab using (term)",
        "latest_articles": f"with {ARTICLES} select doc_id, date, source from articles order by date desc, doc_id limit 100",
        "batch_ids": """select o_orderkey, o_custkey,
  cast(floor((row_number() over (order by o_orderkey) - 1) / 5000) as bigint) as batch_id from orders""",
        "union_sources": """select 'document' as kind, doc_id as id, lang, null as role, md5(text) as text_md5 from documents
union all select 'turn', conv_id, null, role, md5(text) from conversations
union all select 'item', item_id, null, null, md5(text) from benchmark""",
        "html_links": f"""with {SHOWN}, anchors as (
  select page_id, unnest(a) as a, generate_subscripts(a, 1) - 1 as pos from (
    select page_id, regexp_extract_all(html, {quoted(LIST_LINK)}) as a from shown))
select page_id, cast(pos as integer) as pos, {visible('a')} as text, regexp_extract(a, {quoted(ADDRESS)}, 1) as url from anchors""",
        "html_paragraphs": f"with {PARAGRAPHS} select page_id, cast(pos as integer) as pos, text from paragraphs",
        "html_text": f"""with {PARAGRAPHS} select pages.page_id, coalesce(string_agg(text, ' ' order by pos), '') as text
  from pages left join paragraphs using (page_id) group by pages.page_id""",
        "url_parts": r"""select page_id, nullif(regexp_extract(url, '(\d+)', 1), '') as digits,
  nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '') as domain,
  regexp_replace(url, 'https?://', '', 'g') as bare_url,
  regexp_replace(url, 'http://', '', 'g') as bare_http,
  regexp_replace(regexp_replace(url, 'https?://', '', 'g'), '\.[^.]+$', '') as without_suffix,
  regexp_replace(regexp_replace(regexp_replace(url, 'https?://', '', 'g'), '\.[^.]+$', ''), '[./]', '_', 'g') as slug
from pages""",
        "domains_distinct": r"select distinct nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '') as domain from pages",
        "bar_files": f"""with {BARS} select strftime(date, '%Y-%m-%d') || ' 00:00:00+00:00' as date, cast(null as varchar) as open,
  cast(cast(floor(high) as bigint) as varchar) as high, cast(cast(floor(low) as bigint) as varchar) as low,
  case when volume >= 120 then 'halted' else cast(cast(close as bigint) as varchar) end as close,
  cast(volume as varchar) as volume, ticker from bars""",
        "article_files": f"""with {RAW} select date,
  md5('He said "' || replace(text, ' ', chr(10)) || '", \\ or ""so""') as text_md5 from raw""",
        "parquet_by_day": f"""with {ARTICLES} select doc_id, date,
  case when date = date '{tables.FIRST_DAY}' then 'again' else source end as source, false as has_suffix from articles""",
        "fetch_outcomes": """with seen as (
  select url, case when left(md5(url), 1) = '0' then 'Error: too slow' when left(md5(url), 1) in ('1', '2', '3') then 'Failed: 404'
    else 'Success' end as outcome from pages)
select outcome, count(*) as pages, max(case when outcome = 'Success' then url || ' end' end) as last_text from seen group by outcome""",
        "fetch_once": r"""with named as (
  select page_id, case when page_id % 9 > 0 then nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '') || '/' || page_id % 50 end as url
  from pages), seen as (select *, left(md5(url), 1) as digit from named)
select page_id, url, case when digit in ('1', '2', '3') then 404 when digit <> '0' then 200 end as status,
  case when digit in ('1', '2', '3') then '' when digit <> '0' then '<p> ' || url || ' </p><p>end</p>' end as html,
  case when digit = '0' then 'too slow' end as error from seen""",
        "index_rows": r"""with raw as (
  select page_id, case when page_id % 7 = 0 then 'DATE' when page_id % 11 > 0 then '201602' || (page_id % 20 + 10) end as day,
    case when page_id % 3 = 0 then url || '<UDIV>http://second.org/' || page_id when page_id % 5 > 0 then url end as urls from pages),
split_up as (
  select *, unnest(case when urls is null then [null] else string_split(urls, '<UDIV>') end) as url
  from raw where day is null or day <> 'DATE')
select cast(try_strptime(day, '%Y%m%d') as date) as date, url, 'Texas;' || page_id as locations,
  nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '') as domain, sha256(url) as url_key from split_up""",
        "archive_names": """select o_orderkey, strftime(o_orderdate, '%Y%m%d') || '.daily.csv.parquet' as stored_as from orders""",
        "table_page": f"with {BARS} select ticker, date, close, volume from bars order by ticker, date limit 100 offset 200",
        "one_order": "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7",
        "recent_events": """select event_type, count(*) as events, min(cast(ts as date)) as first_day from events
where cast(ts as date) >= current_date - 3650 group by event_type""",
        "bars_clean": f"""with {BARS} select ticker, date, cast(null as double) as open, floor(high) as high, floor(low) as low,
  close, volume from bars where volume < 120 and ticker not in ('Brand#1', 'Brand#24')""",
        "daily_return": bars_select(f"round({DAILY_RETURN}, 6) as daily_return"),
        "sma": bars_select(round_all(smas, 3)),
        "ema": f"with recursive {BARS}, {ema_ctes()} select ticker, date, {round_all(emas, 3)} from ema",
        "macd": f"with recursive {BARS}, {ema_ctes((12, 26))} select ticker, date, round(ema_12 - ema_26, 3) as macd from ema",
        "rsi": f"with {BARS}, {STEPS} select ticker, date, round({RSI}, 6) as rsi from sides",
        "bollinger": bars_select(round_all(bands, 3)),
        "obv": f"with {BARS}, {STEPS} select ticker, date, {OBV} as obv from steps",
        "forward_returns": bars_select(round_all(forwards, 6)),
        "movement_labels": bars_select(moves),
        "vix_left_join": f"""with {BARS}, {SERIES} select ticker, date, close, round(value, 6) as vix_close
  from bars left join series using (date)""",
        "stock_features": f"""with recursive {BARS}, {SERIES}, {ema_ctes()}, {STEPS}
select ticker, date, round(high, 3) as high, round(low, 3) as low, round(close, 3) as close, volume,
  round({DAILY_RETURN}, 3) as daily_return, {round_all(smas, 3)}, {round_all(emas, 3)}, round({RSI}, 3) as rsi,
  {round_all(bands, 3)}, {OBV} as obv, {round_all(forwards, 3)}, round(high - low, 3) as day_range,
  round(ema_12 - ema_26, 3) as macd, {moves}, 0 as earnings_bool, 0 as split_indicator, round(value, 3) as vix_close
from sides join (select ticker, date, {', '.join(emas)} from ema) using (ticker, date) left join series using (date)""",
        "sentiment_stock_join": f"""with {POLARITY}, {EVENT_BARS} select doc_id, date, round(lexicon_polarity, 6) as lexicon_polarity,
  ticker, close, movement from polarity join labelled using (date)""",
        "sentiment_stock_statistics": f"""with {POLARITY}, {EVENT_BARS} select ticker, date, close, movement, count(*) as articles,
  round(avg(lexicon_polarity), 6) as mean, round(min(lexicon_polarity), 6) as minimum, round(max(lexicon_polarity), 6) as maximum,
  round(stddev_samp(lexicon_polarity), 6) as deviation
from polarity join labelled using (date) group by ticker, date, close, movement""",
        "join_moments": f"""with {POLARITY}, {EVENT_BARS} select count(*) as pairs,
  {round_all({f"{p}_{c}": f"{f}({c})" for p, f in (("mean", "avg"), ("std", "stddev_pop")) for c in ("lexicon_polarity", "close", "movement")}, 6)},
  {round_all({f"cov_lexicon_polarity_{c}": f"covar_pop(lexicon_polarity, {c})" for c in ("close", "movement")}, 6)}
from polarity join labelled using (date)""",
        "score_texts": f"""with {ARTICLES}, {SCORED_TWICE} select doc_id, k.label as keywords_label,
  round(k.score, 6) as keywords_score, h.label as headlines_label, round(h.score, 6) as headlines_score
from keywords k join headlines h using (doc_id)""",
        "svm_predictions": f"""with recursive {POLARITY}, {DAILY}, {EVENT_BARS}, {SCORED_TWICE}, {FEATURE_TABLE},
{svm_ctes("fitted", ["close", "mean_polarity"], "feature_table")}
select ticker, date, movement, round(decision, 6) as decision, case when decision > 0 then 1 else 0 end as prediction,
  true as converged from fitted""",
        "model_report": f"""with recursive {POLARITY}, {DAILY}, {EVENT_BARS}, {SCORED_TWICE}, {FEATURE_TABLE},
{", ".join(svm_ctes(f"fit_{name}", features, "feature_table") for name, features in catalog.FEATURE_SETS.items())}
{" union all ".join(report_row(name, f"fit_{name}") for name in catalog.FEATURE_SETS)}""",
        "sentiment_stock_join_daily": f"""with {POLARITY}, {DAILY}, {EVENT_BARS} select ticker, date, close, movement,
  round(mean_polarity, 6) as mean_polarity from labelled join daily using (date)""",
        "hash_split": f"select doc_id, {SPLIT.format('cast(doc_id as varchar)')} as is_test from documents",
        "time_split": f"""with {BARS} select ticker, date, close, date >= date '{test_start}' as is_test from bars
  where date <= date '{train_end}' or date >= date '{test_start}'""",
        "standardize": f"""with {BARS}, split as (
  select ticker, date, close, volume, {BAR_SPLIT} as is_test from bars),
fit as (select avg(close) as mc, stddev_pop(close) as sc, avg(volume) as mv, stddev_pop(volume) as sv from split where not is_test)
select ticker, date, round((close - mc) / sc, 6) as close, round((volume - mv) / sv, 6) as volume, is_test from split, fit""",
        "binary_metrics": """with s as (
  select quality as label, cast(n_chars - 1500 as double) as score from labels join documents using (doc_id)),
r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as mid from s)
select round(avg(case when (score > 0) = (label = 1) then 1.0 else 0.0 end), 6) as accuracy,
  round((sum(case when label = 1 then mid else 0 end) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
    / (count_if(label = 1) * count_if(label <> 1)), 6) as auc from r""",
    }
