import html as stdlib
import re

from pyspark.sql import functions as F

from webloom.functions import html, text, tokens


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_visible_text(spark):
    body = "<html><script>var a = '<b>';</script><STYLE x>p{}</STYLE ><!-- <p>no</p> --><p>a &amp; b&nbsp;c</p>\n d&hellip;</html>"
    assert one(spark, body, text.visible_text) == "a & b c d…"
    assert one(spark, "<script>a</style>b</script>c", text.visible_text) == "c"
    assert one(spark, None, text.visible_text) is None


def test_visible_text_decodes_entities_without_a_semicolon(spark):
    """As the reference does; the queries' SQL doesn't know these (REPLY_r02.md)."""
    body = "<h1>ver&amp;&amp</h1> a&ampb &copy 2024 &lt &nosuch"
    assert one(spark, body, text.visible_text) == "ver&& a&b © 2024 < &nosuch" == stdlib.unescape("ver&amp;&amp a&ampb &copy 2024 &lt &nosuch")


def test_is_substantial(spark):
    shell, full = "<p>Home</p>", "<p>" + "word " * 60 + "</p>"
    for body, least, want in ((shell, 200, False), (full, 200, True), (shell, 0, True), (shell, 4, True)):
        assert one(spark, body, lambda c: text.is_substantial(c, least)) is want
    assert one(spark, shell, lambda c: text.is_substantial(c, 200, F.lit(True))) is True


def test_markdown_to_html(spark):
    md = 'a <b> & [x & y](https://e.com/?a=1&b="2") [rel](/no) [t](http://e.com)'
    want = 'a &lt;b&gt; &amp; <a href="https://e.com/?a=1&amp;b=&quot;2&quot;">x &amp; y</a> [rel](/no) <a href="http://e.com">t</a>'
    assert one(spark, md, text.markdown_to_html) == want


def test_kinds_and_policies(spark):
    kinds = {"text/HTML; x": "html", "application/xhtml+xml": "html", "application/PDF": "pdf", "image/png": "skipped", None: "skipped"}
    assert {k: one(spark, k, text.classify) for k in kinds} == kinds
    accepted = [None, *"|TEXT/PLAIN|text/x-robots|text/plain|text/plain; charset=utf-8".split("|")]
    rejected = "text/xml application/pdf image/png text/html application/json".split()
    assert all(one(spark, k, lambda c: text.looks_like_policy(c, F.lit("User-agent: *"))) for k in accepted)
    assert not any(one(spark, k, lambda c: text.looks_like_policy(c, F.lit("User-agent: *"))) for k in rejected)
    assert not one(spark, "text/plain", lambda c: text.looks_like_policy(c, F.lit("\n <html>")))


def test_stable_filters(spark):
    f = lambda value, name: one(spark, value, getattr(text, name))
    assert f("[m](/cdn-cgi/l/email-protection#0aF3) x", "strip_email_tokens") == "[m](/cdn-cgi/l/email-protection) x"
    assert f('[F](https://www.foundant.com "t 1") y', "strip_portal_footer_title") == "[F](https://www.foundant.com) y"
    sentinel = text._HIDDEN_FIELD
    assert f(f"a\n\nPhone\n\n{sentinel}", "strip_honeypot_label") == f"a\n\n{sentinel}"
    assert f(f"a\n\n{'long ' * 20}\n\n{sentinel}", "strip_honeypot_label") == f"a\n\n{'long ' * 20}\n\n{sentinel}"
    strip = "x\n## Related Guides & Reports\n* a\n* b\n[![](https://e/EREF-white-logo.png)]"
    assert f(strip, "strip_related_carousel") == "x\n[![](https://e/EREF-white-logo.png)]"
    assert f(strip.replace("white", "black"), "strip_related_carousel") == strip.replace("white", "black")
    assert f("a\n| | |\n| --- | --- |\n\nb\n| x |\n| --- |\n", "drop_empty_tables") == "a\n\nb\n| x |\n| --- |\n"


def test_filters_of_strings_and_columns(spark):
    upper = lambda t: t.upper()
    assert one(spark, "a /cdn-cgi/l/email-protection#1", lambda c: text.apply_filters(c, [text.strip_email_tokens, upper])) == "A /CDN-CGI/L/EMAIL-PROTECTION"


def test_links():
    page = (
        '<a href="/a#f">one <b>two</b>\n three</a><a href="">x</a><a>y</a><a href="/a">again</a><a href="javascript:void">j</a>'
        '<a href="JavaScript:x">kept out by scheme</a><a href="ftp://x/">f</a><a href="/p?a=1&amp;b=2">amp</a><a href="/open">never closed <a href="/inner">in</a><a href="#x">h</a><a href="mailto:a@b">m</a>'
    )
    assert html.links_of(page, "http://h.com/d/") == [("one two three", "http://h.com/a"), ("amp", "http://h.com/p?a=1&b=2"), ("in", "http://h.com/inner")]
    assert html.links_of('<a href="https://q[r]s.test/">x</a><a href="/y">y</a>', "http://h.com/") is None
    assert html.links_of(None, "x") == []


def test_markdown():
    page = "<h2>T  t</h2><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>1</li><li>2<ol><li>n</li></ol></li></ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table><script>no</script><pre>x\n  y</pre>"
    md = html.markdown_of(page)
    assert md.startswith("## T t\n\na **b** [l](/x)\n\n* 1\n* 2\n  1. n") and "| h |\n| --- |\n| c |" in md and "no" not in md and "```\nx\n  y\n```" in md
    stream = b"BT (Hello \\(x\\)) Tj [(a) -3 (b)] TJ ET"
    import zlib

    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(stream) + b"\nendstream"
    assert html.read_document(pdf, "application/pdf") == "Hello (x)\nab"


def test_token_split_is_exact():
    body = "Grüße aus dem Wald. " * 50
    parts = tokens.split(body, 16)
    assert "".join(parts) == body and all(tokens.count(p) <= 17 for p in parts) and tokens.split(body, 0) == [body] and tokens.count("") == 0


def test_too_old(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ask = lambda stamp, days: one(spark, stamp, lambda c: text.too_old(c, days, now))
    assert (ask("20240101000000", 10), ask("20240130000000", 10), ask("junk", 10), ask("20200101000000", 0)) == (True, False, False, False)


def test_filters_of_what_changes(spark):
    """Each by what it must take out and what it must leave."""
    run = lambda body, f: one(spark, body, f)
    mail = "[a](/cdn-cgi/l/email-protection#0fA9) [b](/cdn-cgi/l/email-protection#xyz) /cdn-cgi/l/email-protection #12 email-protection#12"
    assert run(mail, text.strip_email_tokens) == mail.replace("#0fA9", "")
    foot = '[F](https://www.foundant.com "t 1 2") [G](https://www.foundant.com) [H](https://www.other.com "x")'
    assert run(foot, text.strip_portal_footer_title) == foot.replace(' "t 1 2"', "")
    notice = "This field is for validation purposes and should be left unchanged."
    assert run(f"a\n\nName\n\n{notice}\nb\n\nComments\n\n{notice}", text.strip_honeypot_label) == f"a\n\n{notice}\nb\n\n{notice}"
    for kept in (f"Name\n\n{notice}", f"a\n\n{'n' * 41}\n\n{notice}", f"a\nName\n\n{notice}", f"a\n\nName\n{notice}", "a\n\nName\n\nThis field is for"):
        assert run(kept, text.strip_honeypot_label) == kept
    strip = "body\n## Related Guides & Reports\n\n* one\n* two\n[![](https://x/EREF-white-logo.png)](/)\nfoot"
    assert run(strip, text.strip_related_carousel) == "body\n[![](https://x/EREF-white-logo.png)](/)\nfoot"
    for kept in (strip.replace("EREF-white", "other"), strip.replace("## Related Guides", "## Other Guides"), strip.removeprefix("body\n")):
        assert run(kept, text.strip_related_carousel) == kept
    assert run(strip, lambda c: text.apply_filters(c, text.STABLE)) == "body\n[![](https://x/EREF-white-logo.png)](/)\nfoot"
    assert run("a\n| | |\n| --- | :-: |\nb\n| x |\n| - |", text.drop_empty_tables) == "a\nb\n| x |\n| - |"
    assert run(None, lambda c: text.apply_filters(c, text.STABLE)) is None and run("", lambda c: text.apply_filters(c, text.STABLE)) == ""
