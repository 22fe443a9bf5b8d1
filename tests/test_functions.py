from datetime import date

import pytest
from pyspark.sql import functions as F

from newsignal.functions import html, labels, text


def test_strip_removes_what_python_strips(column_of):
    values = ["  a b  ", "　x\x0b", "\x1c\x1fy\x85", "z", " \t\r\n", " q "]
    assert column_of(values, text.strip) == [v.strip() for v in values]
    assert sorted(text.SPACES) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


def test_sentinels_become_null(column_of):
    out = column_of(["", "None", "none", None, "a"], lambda c: text.empty_to_null(c, ("", "None")))
    assert out == [None, None, "none", None, "a"]


def test_url_parts(column_of):
    urls = ["https://www.a-b.org/x/y.z.html", "http://m.site.com", "ftp://q", None]
    assert column_of(urls, text.domain) == ["a-b.org", "m.site.com", None, None]
    assert column_of(urls, text.slug) == ["www_a-b_org_x_y_z", "m_site", "ftp:__q", None]
    assert column_of(urls, lambda c: text.strip_protocol(c, https=False))[0].startswith("https://")
    assert column_of(["20160226.x.zip", "none"], text.first_digits) == ["20160226", None]
    assert column_of(["20160226.csv.zip"], text.swap_suffix) == ["20160226.csv.parquet"]
    assert column_of(["a<UDIV>b", "c"], text.split_urls) == [["a", "b"], ["c"]]


def test_bad_numbers_and_dates_are_null(column_of):
    assert column_of(["1.5", "abc", "nan", "inf", "", None], text.number) == [1.5] + [None] * 5
    assert column_of(["20240131", "20240231", "x", None], text.compact_day) == [date(2024, 1, 31), None, None, None]
    assert column_of(["2024-01-31 00:00:00-05:00", "Price"], text.day) == [date(2024, 1, 31), None]


def test_contains_any_case(column_of):
    terms = ["Iowa", "ESTÉE"]
    assert column_of(["in Iowa", "iowa", "estée", ""], lambda c: text.contains_any(c, terms)) == [True, False, False, False]
    assert column_of(["in Iowa", "iowa", "estée", ""], lambda c: text.contains_any(c, terms, True)) == [True, True, True, False]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_long_term_lists_match_alike(column_of, monkeypatch, ignore_case):
    terms = ["a.b", "[x]", "c d", "-e", "^f", "g\\\\", "&&", "É", "h|i", "$", "😀j", "k]"]
    values = ["aXb", "A.B", "[X]", "c d", "-e", "^", "f", "g\\\\", "&&", "é", "h", "h|I", "$", "😀J", "😀j", "K]", "", None]
    monkeypatch.setattr(text, "CHAINED_TERMS", 100)
    chain = column_of(values, lambda c: text.contains_any(c, terms, ignore_case))
    monkeypatch.setattr(text, "CHAINED_TERMS", 1)
    assert column_of(values, lambda c: text.contains_any(c, terms, ignore_case)) == chain


def test_polarity_classes(column_of):
    values = [-1.0, -0.5, -0.1, 0.0, 0.1, 0.5, 0.51, None]
    assert column_of(values, labels.five_way, "double") == [
        "Very_Negative", "Slight_Negative", "Slight_Negative", "Neutral",
        "Slight_Positive", "Slight_Positive", "Very_Positive", None,
    ]
    assert column_of(values, labels.three_way, "double") == (
        ["negative"] * 3 + ["neutral"] + ["positive"] * 3 + [None]
    )


def test_flags_treat_null_as_low(column_of):
    assert column_of([5, 4, None], lambda c: labels.at_least(c, 5), "int") == [1, 0, 0]
    assert column_of([5, 4, None], lambda c: labels.below(c, 5), "int") == [0, 1, 1]
    assert column_of([1.0, 0.0, -1.0, None], labels.movement, "double") == [1, 0, 0, 0]
    assert column_of([0.0, 2.0], lambda c: labels.percent_of(F.lit(1.0), c), "double") == [None, 50.0]


def test_signed_score(spark):
    df = spark.createDataFrame([("NEGATIVE", 0.4), ("POSITIVE", 0.4), (None, None)], "l string, s double")
    out = df.select(
        labels.signed(F.col("l"), F.col("s")).alias("s"), labels.label_or_unknown(F.col("l")).alias("l")
    )
    assert [tuple(r) for r in out.collect()] == [(-0.4, "NEGATIVE"), (0.4, "POSITIVE"), (0.0, "UNKNOWN")]


PAGE = """<html><head><title>t</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body><ul><li><a href="/one">First &amp;lt; link</a></li><li class="x"><a class="b" href='two'> Two </a></li>
<li>plain</li></ul><a href="/three">outside</a><!-- <p>hidden</p> --><pre>code</pre>
<p>One <b>bold</b>&nbsp;</p> between <P class="q">Two<br>lines<p>Three &quot;q&quot; &copy;</p><p></p>
<div><p>unclosed</div> footer</body></html>"""


def test_paragraphs(column_of):
    found = column_of([PAGE, "no markup", ""], html.paragraphs)
    assert found == [["One bold", "Twolines", 'Three "q" ©', "", "unclosed"], [], []]
    assert column_of([PAGE], html.article_text) == ['One bold Twolines Three "q" ©  unclosed']


def test_links_of_list_items(column_of):
    found = column_of([PAGE, ""], html.links)
    assert [tuple(r) for r in found[0]] == [("First &lt; link", "/one"), ("Two", "two")]
    assert found[1] == []


def test_references_are_decoded_once(column_of):
    values = ["&#8217;&#x27;&eacute;", "&amp;#39; &#38;lt;", "&unknown; & &#0; &#xD800; &#9999999;", "a&nbsp;b&apos;", "&#128512;", None]
    assert column_of(values, html.decode) == ["’'é", "&#39; &lt;", values[2], "a\u00a0b'", "😀", None]


def test_paragraphs_keep_inner_blocks_and_plain_signs(column_of):
    assert column_of(["<p>a<div>b</div>c</p>d", "<p>x < 3 and y > 2</p>"], html.paragraphs) == [["abc"], ["x < 3 and y > 2"]]


def test_links_anywhere_in_an_item(column_of):
    page = "<ol><li>see <a href=/u>U</a> or <b><a class=x href='q'>Q</a></b><li><a name=n>N</a><a href=\"r\">R</a></li></ol><a href=o>O</a>"
    assert [tuple(r) for r in column_of([page], html.links)[0]] == [("U", "/u"), ("Q", "q"), ("R", "r")]


def test_links_at_any_depth_and_after_nested_lists(column_of):
    page = (
        "<a href=out>0</a><ul><li>a <a href=1>one</a><ul><li><a href=2>two</a></li></ul> tail <a href=3>three</a></li>"
        "<li><p><b><a href=4>fo<i>ur</i></a></b></p><a href=5>unclosed</ul><a href=no>after</a>"
        "<ol><li><UL></ul><a href='6'>six</a><a name=x>no address</a></ol></li><a href=no2>end</a>"
    )
    found = column_of([page, "<li><a href=x>stray", "</li></ul>", None], html.links)
    assert [tuple(r) for r in found[0]] == [
        ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("unclosed", "5"), ("six", "6")
    ]
    assert [tuple(r) for r in found[1]] == [("stray", "x")] and found[2:] == [[], None]


def test_references_of_the_standard(column_of):
    import html as standard

    values = [
        "a&nbspb &notit; &not; &notin; &NotEqualTilde;", "&#150;&#x80;&#129;", "&copy2024 &ampamp; &amp", "&AMP;&lt&gt", "&hellip;&hearts;",
        "&#0065;&#x00041 x&#65x", "&bogus; &;&#;&#x; & &&amp;",
    ]
    want = [standard.unescape(v) for v in values]
    want[1] = "–€\x81"
    assert column_of(values, html.decode) == want
