"""The web catalogue: a planted string of every family is found, plain requests are silent, and the prefilter loses nothing."""

import random
import re

from pyspark.sql import functions as F

from fieldtrace import catalogue as cat
from fieldtrace.functions.prefilter import possible, possible_alternatives, required
from fieldtrace.operators import web

REQUEST = "seq long, ts_us long, src_ip string, dst_ip string, method string, uri string, body string, headers_raw string, user_agent string, content_type string"
PLANTED = {
    "SQL_INJECTION": ("/p?id=1 and extractvalue(1,concat(0x7e,version()))", ""), "XSS_ATTACK": ("/p?q=<input onhashchange=alert(1)>", ""), "PATH_TRAVERSAL": ("/static/..;/..;/x", ""),
    "WEBSHELL": ("/x", "<?php @proc_open($_POST['a']); ?>"), "WEBSHELL_CMD": ("/x?command=uname -r", ""), "WEBSHELL_JSP": ("/x", "Class.forName('java.x')"), "WEBSHELL_ASPX": ("/x", "<% eval(request('a')) %>"),
    "FILE_UPLOAD_DANGER": ("/u", 'Content-Disposition: form-data; filename="a.ashx"'), "FILE_UPLOAD_BINARY": ("/u", "Content-Type: application/x-msdownload"), "OBFUSCATION_BASE64": ("/x", "x = b64decode (y)"),
    "OBFUSCATION_ENCODING": ("/x", "quoted_printable_decode(z)"), "OBFUSCATION_EVAL_CHAIN": ("/x", "assert( strrev ('x'))"), "HEADER_ANOMALY": ("/x", ""), "SUSPICIOUS_USER_AGENT": ("/x", ""),
    "HTTP_SCANNER_DETECTION": ("/server-status?auto", ""), "SCANNER_BEHAVIORAL_INDICATORS": ("/x?a=${jndi:ldap://h/a}", ""), "COMMAND_INJECTION": ("/x?h=a;nslookup x.y", ""), "XXE_INJECTION": ("/x", "<!ENTITY % a SYSTEM 'b'>"),
    "SSRF_ATTACK": ("/x?u=http://100.100.100.200/", ""), "TEMPLATE_INJECTION": ("/x?n=''.__class__.__mro__", ""), "DESERIALIZATION": ("/x", "org.apache.commons.collections.functors"), "CRLF_INJECTION": ("/x%250d%250ay", ""),
    "OT_HMI_ACCESS": ("/webvisu/a.htm", ""), "OT_CONFIG_FILE_ACCESS": ("/files/line1.l5x", ""), "OT_PROTOCOL_INJECTION": ("/x", "opc.tcp://10.1.1.1:4840"), "LDAP_INJECTION": ("/x?u=*)(uid=a", ""),
    "NOSQL_INJECTION": ("/x?a[$exists]=1", ""), "OPEN_REDIRECT": ("/x?dest=//evil.example", ""), "SENSITIVE_DATA_EXPOSURE": ("/a/.git-credentials", "")}


def request(seq, uri="/x", body="", method="POST", headers="Host: h\r\nX-Real-IP: 10.0.0.1", agent="xsstrike/3"):
    return (seq, seq, "a", "b", method, uri, body, headers, agent, "text/plain")


def categories(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["seq"], set()).add(r["anomaly_type"].removeprefix("HTTP_"))
    return found


def test_every_family_is_found(spark):
    assert set(PLANTED) == {p.category for p in cat.HTTP_CATALOGUE}
    names = sorted(PLANTED)
    rows = spark.createDataFrame([request(i, *PLANTED[n]) for i, n in enumerate(names)], REQUEST)
    found = categories(web.http_pattern_rules(rows))
    assert [n for i, n in enumerate(names) if n not in found.get(i, set())] == []


def test_plain_requests_are_silent(spark):
    agent = "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0"
    plain = [("/", ""), ("/shop/items?page=2&sort=price", ""), ("/api/v1/users/17", '{"name": "Anna", "tags": ["a", "b"], "note": "select a colour, then order by phone"}'), ("/search?q=union+station+and+hotel", ""),
             ("/form", "first=Ada&last=Lovelace&message=I+would+like+to+host+a+party;+please+call"), ("/blog/2024/05/how-we-execute-plans", ""), ("/img/logo.png", ""), ("/docs/plc-basics.html", ""),
             ("/text", "They touch the ground.\nhost and guest\nkill time\nfind the way, ping pong is fun."), ("/css/site.css?v=3", ""), ("/cart", "item=12&count=3&total=99.90")]
    rows = spark.createDataFrame([request(i, u, b, "POST" if b else "GET", "Host: shop.example\r\nAccept: text/html", agent) for i, (u, b) in enumerate(plain)], REQUEST)
    assert categories(web.http_pattern_rules(rows)) == {}


def test_prefilter_loses_nothing(spark):
    rng = random.Random(1)
    alphabet = ["'", "or", " ", "1", "=", "/", "eval", "(", "$_GET", "[", "..", "%2e", "script", "<", "base64_decode", "\\x41", "curl", "http://", "union", "select", "id", ";", "|", "{", "$", "a:1:{", "\n", "UNION"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([request(i, t[:30], t, "POST", t, t[:9]) for i, t in enumerate(texts)], REQUEST)
    got, every = categories(web.http_pattern_rules(rows)), {}
    for row in web.search_texts(rows).collect():
        for p in cat.HTTP_CATALOGUE:
            if any(re.search(p.regex, row[c], re.ASCII) for t in p.targets for c in web._PLACES[t]):
                every.setdefault(row["seq"], set()).add(p.category)
    assert got == every and len(every) > 100
    assert required(r"\bunion\b.{0,40}\bselect\b") == {"select"} and required("(?i)(ab|c)x?") == {"ab", "c"} and required(r"[a-z]{3,}") is None and required("a?b*") is None
    found = spark.createDataFrame([("x SELECT y",), ("none",), (None,)], "t string").select(possible(F.col("t"), ["union|select", "[a-z]+", "zz"]).alias("p")).collect()
    assert [r["p"] for r in found] == [[0, 1], [1], None]


def test_only_alternatives_whose_literals_occur_are_run(spark):
    rows = spark.createDataFrame([("the Location of a net",), ("none",), ("xx cat zz",), (None,)], "t string")
    found = rows.select(possible_alternatives(F.col("t"), [("(?i)", ["cat\\s", "net|web", "[a-z]+", "zz"]), ("", ["Q"])]).alias("p")).collect()
    assert [r["p"] for r in found] == [["(?i)(?:cat\\s|net|web)", None], [None, None], ["(?i)(?:cat\\s|zz)", None], None]
    # a text of common words meets a few of the hundreds of alternatives
    prose = spark.createDataFrame([("please call the net cafe, its location is on the dashboard of the city",)], "t string")
    run = prose.select(possible_alternatives(F.col("t"), [("(?i)", p.alternatives) for p in cat.HTTP_CATALOGUE]).alias("p")).first()["p"]
    assert sum(map(len, filter(None, run))) < sum(len(p.regex) for p in cat.HTTP_CATALOGUE) / 20


def test_execution_in_four_languages(spark):
    bodies = ["system($a); exec($b); pcntl_exec($c)", "new ProcessBuilder(x); p.getInputStream()", "ProcessStartInfo i; Process.Start(i)", "import os; os.system(c); subprocess.Popen(c)", "os.system"]
    rows = spark.createDataFrame([request(i, "/x", b) for i, b in enumerate(bodies)] + [request(9, "/a/matamu.php")], REQUEST)
    assert {r["seq"]: r["anomaly_type"] for r in web.webshell_access(rows).collect()} == {
        0: "WEBSHELL_EXECUTION_PHP", 1: "WEBSHELL_EXECUTION_JSP", 2: "WEBSHELL_EXECUTION_ASPX", 3: "WEBSHELL_EXECUTION_PYTHON", 9: "WEBSHELL_ACCESS"}
    for command in ("socat tcp-connect:1", "x; id | y", "a; hostname"):
        assert web.http_command_execution(spark.createDataFrame([request(1, "/x", command)], REQUEST)).count() == 1
    assert web.http_command_execution(spark.createDataFrame([request(1, "/x?hostname=a", "my.hostname=b")], REQUEST)).count() == 0
