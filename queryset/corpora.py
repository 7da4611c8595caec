"""Corpora made from the driver's tables, in Spark and in SQL.

The tables hold prose, on which few rules match, so a source corpus is rendered from
`customer`: each row becomes one file whose path, language and lines follow from its key.
Every rule has lines that match and lines that nearly do. Both engines render it with the
same string functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.sources.tables import from_table, spread

# Snippets for every language. {n} is the customer key, {p16} and {p36} the key padded
# with zeros, {w} the market segment in lower case, {N} the customer's name.
COMMON = [
    'password = "{N}"',
    "passwd: '{w}{n}'\npwd = '{n}'",
    'password = os.environ["DB_{n}"]',
    'api_key = "{p16}"\nAPI-Secret : \'{p16}\'',
    'apikey = "{n}"',
    'token = "{p36}"\naccess_token: "{w}{p16}"',
    'secret = ""\nbearer = "abc\ndef{n}"',
    'AWS = "AKIA{p16}"',
    "region = 'asia-{n}' # eurasia",
    "-----BEGIN RSA PRIVATE KEY-----\n{p36}\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN OPENSSH PRIVATE KEY-----",
    'MY_SECRET_KEY = "{p36}"',
    'CREDENTIAL_X: "short{n}"',
    "DEBUG = True\ndebug: 1",
    "debug = no{n}",
    'Access-Control-Allow-Origin: "*"\ncors_allow_origins = \'*\'',
    "url = 'http://{w}.shop.net/{n}' or https://example.com/{n}",
    "see http://localhost:{n}/x and HTTPS://www.{w}.org.",
    "h = hashlib.md5(x) + SHA1 (y)",
    "md5sum file{n}",
    "os.chmod(path, 0o777)\nchmod(p, 0777)",
    "chmod 777 /tmp/{n}",
    "# TODO: fix {n}\n#FIXME\n# todos remain",
    "catch (e) { }\ncatch (Exception {w}) {\n}",
    "for row in rows:\n    db.query(row, {n})\n",
    "for x in y: pass\n\n  z.getter({n})",
    "pip install {w}\nnpm install left-pad@{n}",
    "gem install rails  ",
    'gh = "ghp_{p36}"',
    "https://hooks.slack.com/services/T{n}A/B{n}C/{p16}",
    'g = "AIza{p36}"',
    'stripe = "sk_live_{p36}" # rk_live_{n}',
    "postgres://admin:{w}pw@db.{w}.example.com:5432/d{n}",
    "redis://{w}@host/{n} mongodb+srv://u:{p16}@m",
    'h = {"Authorization": "Bearer {p36}"}',
    "algorithms = ['none']\njwt.decode(t, verify=False)",
    'jwt.encode(p, "{w}-{p16}")',
    "cipher = DES.new(k)  # AES.MODE_ECB, describe",
    "mode = 'ECB'; rc4{n}",
    "iv = b'{p16}'\nnonce = bytes(16)",
    "give = b'{n}'",
    "print(os.environ['K{n}'])\nlogger.info(process.env.{w})",
    "value{n} = compute({n})\n\n",
    "naïve café {N} — ünïcode",
]

# Snippets by language, with the file suffix of each language.
SPECIFIC = [
    ("python", ".py", [
        "cursor.execute(f'SELECT {n}')\nquery(\"a %s\" % {n})",
        "execute('SELECT 1', ({n},))",
        "subprocess.run(cmd, shell=True)\nsubprocess.run(cmd, shell=False) or os.popen(c{n})",
        "os.system('rm %s' % {n})\nos.system(f\"ls {w}\")",
        "eval(x{n})\nmedieval(y) retrieval (z)",
        "pickle.loads(b)\nyaml.load(f)\nyaml.safe_load(f)",
        "requests.get(u, verify=False)\nverify = True",
        "random.randint(0, {n}) + random.choice (s)",
        "try:\n  f()\nexcept Exception:\n  pass\nexcept:\n  ...\n",
        "except ValueError:\n    pass",
        "def f{n}(a=[], b={}):\n    pass\ndef g(s=set()):",
        "async def load(p):\n    x = {n}\n    y = open(p) or os.path.join(p)\n    z = open(p)",
        "await read(open(f))\nawait sleep({n})",
        "for p in ps:\n    s = 1\n    re.search(p, s)\n    re.sub(a, b)",
        "requests.post(f'http://{w}')\nrequests.get(base + request.args)",
        "requests.get(url{n})",
        "open(os.path.join(d, request.path))\nPath(f'{params}/{n}')",
        "redirect(request.args)\nHttpResponseRedirect(params['{w}'])",
        "render_template_string(t{n})",
        "mark_safe('<b>' + x)\nmark_safe(y{n})",
        "Model.objects.raw(f'SELECT {n}')\nRawSQL('x'.format(1))",
        "app.secret_key = '{w}'\nconfig['SECRET_KEY'] = \"{p16}\"",
        "send_file(request.args['f'])\nsend_file(os.path.join(d, request.f))",
        "tempfile.mktemp() or os.tempnam()",
        "assert user.is_admin\nassert user{n}",
        "marshal.loads(b); shelve.open(p)",
        "User.objects.create(request.data)\nx.update(request.json)",
    ]),
    ("javascript", ".js", [
        "el.innerHTML = x{n};\nel.innerHTML == y;\nel.innerHTML=\nz",
        "q = 'SELECT * FROM t' + req.body.{w};\nDELETE FROM x + params.y",
        "new Function('a', b{n})\nnewFunction(c)",
        "if (a == b || c === d || e != f) { g{n} }\nx==y",
        "console.log('{w}');\nconsole.error({n})",
        "fetch(`http://x/${id}`)\naxios.get(base + req.url)",
        "fs.readFileSync(req.query.f)\nfs.access(params.p{n})",
        "res.redirect(req.query.url)\nres.redirect('/{w}')",
        "<div dangerouslySetInnerHTML={{__html: h{n}}} />",
        "<a href='javascript:void({n})'>",
        "document.write(x); document.writeln(y{n})",
        "child_process.exec(`ls ${d}`)\nchild_process.execSync('a' + req.b)",
        "rejectUnauthorized: false\nNODE_TLS_REJECT_UNAUTHORIZED = '0'",
        "id = Math.random() + Math.random( )",
        "Model.findOneAndUpdate(req.body)\nm.updateOne(x{n})",
        "eval('x{n}')",
    ]),
    ("typescript", ".tsx", [
        "this.ref.innerHTML = html{n}",
        "console.log(`${x}`)\nInsert into t + query.{w}",
        "setTimeout(new  Function ('x'))",
        "return <div dangerouslysetinnerhtml={x{n}} />;",
        "axios.post(`${host}/{n}`)",
        "fs.createReadStream( request.path )\nres.redirect(req.body['u'])",
        "href = \"javascript:go({n})\"\ndocument.write (z)",
        "child_process.exec(cmd + body.x{n})",
        "rejectunauthorized=false; Math.random ( )",
        "db.create(req.body); a == b",
    ]),
    ("go", ".go", [
        "db.Query(fmt.Sprintf(\"SELECT %d\", {n}))\ndb.Exec(\"x\" + y)",
        "db.QueryRow(\"SELECT $1\", {n})",
        "func {w}() { eval(x) }",
    ]),
    ("yaml", ".yml", [
        "privileged: true\nprivileged: false",
        "runAsUser: 0\nrunAsUser: 0{n}\nrunAsUser: 1000",
        "hostNetwork: true\nhostPID:true\nhostIPC: no",
    ]),
    ("dockerfile", "", [
        "FROM python\nFROM node:18\nFROM {w}:latest",
        "CMD run{n}\nUSER app CMD x\nENTRYPOINT [\"a\"] CMD b",
        "ADD a{n} /b\nADD http://x/y /z\nADD  https://x/y /z\nLADD q",
        "ARG DB_PASSWORD\nENV API_TOKEN_{n} x\nENV PATH /bin",
        "EXPOSE 22\nEXPOSE 8080\nEXPOSE 3306 {n}\nEXPOSE 220",
    ]),
    ("terraform", ".tf", [
        "acl = \"public-read\"\nacl = \"private\"",
        "cidr_blocks = [\"0.0.0.0/0\"]\ncidr_blocks = [\"10.0.0.0/8\"]",
        "publicly_accessible = true\npublicly_accessible = false # {n}",
    ]),
    ("shell", ".sh", ["echo {w} {n}", "export PWD='{p16}'"]),
    ("ruby", ".rb", ["puts '{w}'", "except = {n}: pass"]),
    (None, ".md", ["# {N}", "plain text {n}"]),
]

_KINDS = len(SPECIFIC)

# Directories, by key; some are never entered.
DIRECTORIES = [
    "src", "src/app", "_private", "lib/.hidden", "node_modules/pkg", "a/build/b", "builder",
    ".git/hooks", "docs.d", "env", "x.egg-info", "deep/er/and/deeper",
]

_SNIPPETS_PER_FILE = 7

#: Rows of `customer` that one task renders, about.
ROWS_A_TASK = 10_000


def _templates() -> list[tuple[int, list[str]]]:
    return [(kind, own + COMMON) for kind, (_, _, own) in enumerate(SPECIFIC)]


def _file_name(kind: int) -> str:
    """A file name's pattern for one kind of file; {n} is the key."""
    language, suffix, _ = SPECIFIC[kind]
    if language == "dockerfile":
        return "Dockerfile.{n}"
    return {"python": "_f{n}.PY", "ruby": ".r{n}.rb"}.get(language, "f{n}" + suffix)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered corpus: path, language, size, text."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    templates = spark.createDataFrame(
        [(k, snippets, _file_name(k)) for k, snippets in _templates()],
        "kind bigint, snippets array<string>, name string",
    )
    key = F.col("c_custkey")
    # Slim rows that become texts: dealt out evenly, in tasks whose number grows with the table.
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-customers.count() // ROWS_A_TASK))
    joined = customers.repartition(tasks).withColumn("kind", key % _KINDS).join(
        F.broadcast(templates), "kind"
    )
    start = F.floor(key / _KINDS) * 5
    count = F.size("snippets")
    picked = [
        F.element_at("snippets", ((start + j) % count + 1).cast("int"))
        for j in range(_SNIPPETS_PER_FILE)
    ]
    text = F.concat(F.concat_ws("\n", *picked), F.when(key % 3 == 0, "\n").otherwise(""))
    values = {
        "{n}": key.cast("string"),
        "{p16}": F.lpad(key.cast("string"), 16, "0"),
        "{p36}": F.lpad(key.cast("string"), 36, "0"),
        "{w}": F.lower("c_mktsegment"),
        "{N}": F.col("c_name"),
    }
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    text = (
        F.when(key % 7 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(key % 11 == 3, F.replace(text, F.lit("\n"), F.lit("\r")))
        .otherwise(text)
    )
    text = F.when(key % 97 == 5, "").otherwise(text)
    directories = F.array(*[F.lit(d) for d in DIRECTORIES])
    directory = F.element_at(
        directories, (F.floor(key / _KINDS) % len(DIRECTORIES) + 1).cast("int")
    )
    path = F.concat_ws("/", directory, F.replace("name", F.lit("{n}"), key.cast("string")))
    rows = joined.select(key.alias("key"), path.alias("path"), text.alias("text"))
    claimed = F.when(F.col("key") % 31 == 0, F.lit(1_000_000) + F.col("key") % 2)
    size = F.when(F.col("key") % 41 != 7, F.coalesce(claimed, F.octet_length("text")))
    return from_table(rows, "path", "text", size=size)


# How often `dense` holds each rendered file.
COPIES = 16


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short files in which most lines match a rule: the rendered ones under several paths."""
    files = rendered(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    path = F.concat_ws("/", F.concat(F.lit("copy"), "copy"), "path")
    return files.withColumn("path", path).drop("copy")


def documents(spark: SparkSession, sf_dir: str, language: str = "python") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return from_table(spread(table), "doc_id", "text", language)


def pages(spark: SparkSession, sf_dir: str, language: str = "javascript") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "page_id", "html")
    return from_table(spread(table), F.concat_ws("#", "url", "page_id"), "html", language)


def conversations(spark: SparkSession, sf_dir: str, language: str = "shell") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return from_table(spread(table), path, "text", language)


# The same corpora in SQL. Each is a table expression `files(path, language, size, text)`,
# text as stored.


def quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def language_sql(path: str) -> str:
    """Language of a path, written as one suffix test per language."""
    name = f"regexp_extract({path}, '[^/]*$')"
    cases = [
        f"WHEN {name} = 'Dockerfile' OR starts_with({name}, 'Dockerfile.') THEN 'dockerfile'",
        f"WHEN {name} IN ('Makefile', 'makefile', 'GNUmakefile') THEN 'shell'",
    ]
    for language, suffixes in schema.LANGUAGE_SUFFIXES.items():
        if suffixes:
            ends = "|".join(s.replace(".", r"\.") for s in suffixes)
            cases.append(rf"WHEN regexp_matches({name}, '(?i)^\.*[^.].*({ends})$') THEN '{language}'")
    return "CASE " + " ".join(cases) + " ELSE NULL END"


def rendered_sql() -> str:
    values = ", ".join(
        f"({k}, {_sql_list(snippets)}, {quote(_file_name(k))})" for k, snippets in _templates()
    )
    picked = ", ".join(
        f"snippets[((c_custkey // {_KINDS}) * 5 + {j}) % len(snippets) + 1]"
        for j in range(_SNIPPETS_PER_FILE)
    )
    text = f"concat_ws(chr(10), {picked}) || CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END"
    for mark, value in {
        "{n}": "c_custkey::VARCHAR",
        "{p16}": "lpad(c_custkey::VARCHAR, 16, '0')",
        "{p36}": "lpad(c_custkey::VARCHAR, 36, '0')",
        "{w}": "lower(c_mktsegment)",
        "{N}": "c_name",
    }.items():
        text = f"replace({text}, '{mark}', {value})"
    directory = f"({_sql_list(DIRECTORIES)})[(c_custkey // {_KINDS}) % {len(DIRECTORIES)} + 1]"
    return f"""(
  SELECT path, {language_sql('path')} AS language,
         CASE WHEN c_custkey % 41 = 7 THEN NULL WHEN c_custkey % 31 = 0 THEN 1000000 + c_custkey % 2
              ELSE strlen(text) END AS size,
         text
  FROM (
    SELECT c_custkey, {directory} || '/' || replace(name, '{{n}}', c_custkey::VARCHAR) AS path,
           CASE WHEN c_custkey % 97 = 5 THEN ''
                WHEN c_custkey % 7 = 0 THEN replace(raw, chr(10), chr(13) || chr(10))
                WHEN c_custkey % 11 = 3 THEN replace(raw, chr(10), chr(13))
                ELSE raw END AS text
    FROM (SELECT *, {text} AS raw
          FROM customer JOIN (VALUES {values}) AS t(kind, snippets, name)
            ON c_custkey % {_KINDS} = kind)
  )
)"""


def documents_sql(language: str = "python") -> str:
    return (
        f"(SELECT doc_id::VARCHAR AS path, '{language}' AS language, strlen(text) AS size, text "
        "FROM documents)"
    )


def pages_sql(language: str = "javascript") -> str:
    return (
        f"(SELECT url || '#' || page_id AS path, '{language}' AS language, strlen(html) AS size, "
        "html AS text FROM pages)"
    )


def conversations_sql(language: str = "shell") -> str:
    return (
        f"(SELECT conv_id || '/' || turn AS path, '{language}' AS language, strlen(text) AS size, "
        "text FROM conversations)"
    )
