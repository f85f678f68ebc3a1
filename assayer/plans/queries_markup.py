"""Markup detectors over pages, and the source kernels over a small literal repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import colour
from assayer.operators.common import table
from assayer.plans import scan as S
from assayer.plans.registry import query
from assayer.sources import tables


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return tables.html_nodes(pages)


def _page(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").cast("bigint").alias("page_id"), *[c for c in df.columns if c != "path"])


@query("a11y_lang", "SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) lang FROM pages")
def _(spark, sf_dir):
    return _page(nodes(spark, sf_dir).where("tag = 'html'").select("path", F.coalesce(F.expr("attrs['lang']"), F.lit("")).alias("lang")))


@query("a11y_title", "SELECT page_id, (length(html) - length(replace(html, '<title>', ''))) // 7 titles, regexp_matches(html, '<title>\\s*\\S') named FROM pages")
def _(spark, sf_dir):
    t = nodes(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("tag") == "title").alias("titles"), F.coalesce(F.bool_or((F.col("tag") == "title") & (F.col("text") != "")), F.lit(False)).alias("named"))
    return _page(t)


@query("a11y_main", "SELECT page_id, (length(html) - length(replace(html, '<h1', ''))) // 3 h1, (length(html) - length(replace(html, '<article', ''))) // 8 articles, contains(html, '<main') has_main FROM pages")
def _(spark, sf_dir):
    is_ = lambda t: F.col("tag") == t
    t = nodes(spark, sf_dir).groupBy("path").agg(F.count_if(is_("h1")).alias("h1"), F.count_if(is_("article")).alias("articles"), F.bool_or(is_("main")).alias("has_main"))
    return _page(t)


@query("a11y_anchors", "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) href FROM pages) SELECT page_id, count(*) links, count(*) FILTER (href LIKE '#%') local FROM a GROUP BY 1")
def _(spark, sf_dir):
    href = F.expr("attrs['href']")
    t = nodes(spark, sf_dir).where("tag = 'a' and attrs['href'] is not null").groupBy("path").agg(F.count(F.lit(1)).alias("links"), F.count_if(href.startswith("#")).alias("local"))
    return _page(t)


#: What is put behind each page, by the remainder of its id: markup that breaks a rule, and markup that comes close. (every so many pages, markup, rules with their message.)
_FRAGMENTS = [
    (2, '<img src="a.png">', [("missing-text-alternative", "image without a text")]), (3, '<img src="a.png" alt=""><img src="b.png" alt="B">', []), (3, '<input type="text">', [("form-control-without-label", "control without a label")]),
    (2, '<label>Q<input type="text"></label><label for="z">Z</label><input id="z">', []), (5, '<iframe src="x"></iframe>', [("page-structure-violation", "frame without a title")]), (4, '<div onclick="go()">x</div>', [("non-keyboard-accessible-interaction", "click without a keyboard")]),
    (7, '<a href="#">top</a>', [("non-keyboard-accessible-interaction", "link to nowhere")]), (6, '<span role="buton">x</span><span role="button" tabindex="0">y</span>', [("invalid-aria-usage", "unknown role")]), (5, '<video autoplay></video><video autoplay controls></video>', [("autoplay-media-without-control", "plays by itself")]),
    (3, '<button></button><button aria-label="go"></button><button>go</button>', [("form-control-without-label", "button or link without a name")]), (4, '<div role="dialog">d</div><div role="dialog" aria-modal="true">d</div>', [("modal-focus-not-managed", "dialog that is not modal")]),
]
_BROKEN = " UNION ALL ".join(f"SELECT '{r}' rule_id, '{m}' message, page_id FROM pages WHERE page_id % {k} = 0" for k, _, found in _FRAGMENTS for r, m in found)


@query("a11y_findings", f"WITH f AS ({_BROKEN}) SELECT rule_id, message, count(*) n, count(DISTINCT page_id) pages FROM f GROUP BY 1, 2")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    more = F.concat(*(F.when(F.col("page_id") % k == 0, text).otherwise("") for k, text, _ in _FRAGMENTS))
    found = S.element_findings(tables.html_nodes(pages.select(F.col("page_id").cast("string").alias("path"), F.concat("html", more).alias("text"))))
    return found.groupBy("rule_id", "message").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("pages"))


_PAIRS = [("#000000", "#ffffff"), ("#777", "#fff"), ("#767676", "#FFFFFF"), ("#ff0000", "#00ff00"), ("#123456", "#abcdef"), ("#336699", "#ccc")]
_LUM = "0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2}"
_LIN = "(CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END)"
_CHANNELS = {"#000000": (0, 0, 0), "#ffffff": (255, 255, 255), "#777": (119, 119, 119), "#fff": (255, 255, 255), "#767676": (118, 118, 118), "#FFFFFF": (255, 255, 255), "#ff0000": (255, 0, 0), "#00ff00": (0, 255, 0), "#123456": (18, 52, 86), "#abcdef": (171, 205, 239), "#336699": (51, 102, 153), "#ccc": (204, 204, 204)}


@query(
    "css_contrast",
    "WITH c(name, r, g, b) AS (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]})" for k, v in _CHANNELS.items()) + f"), l AS (SELECT name, {_LUM.format(*(_LIN.format(x) for x in 'rgb'))} y FROM c), p(fg, bg) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)
    + ") SELECT fg, bg, round((greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05), 4)::DOUBLE ratio FROM p JOIN l a ON a.name = fg JOIN l b ON b.name = bg",
)
def _(spark, sf_dir):
    pairs = spark.createDataFrame(_PAIRS, "fg string, bg string")
    return pairs.select("fg", "bg", F.round(colour.contrast(colour.hex6(F.col("fg")), colour.hex6(F.col("bg"))), 4).alias("ratio"))


#: A repository of a few files in which many rules fire.
SAMPLE = {
    "src/Shop.Domain/Order.cs": """namespace Shop.Domain;
public class Order : Entity
{
    public int Id { get; set; }
    public string Name { get; set; }
    public decimal Total { get; set; }
}
public class OrderCreate_Event { }
public class PaymentFailedEvent { public int Id { get; init; } }
""",
    "src/Shop.Web/Orders.cs": """using System;
namespace Shop.Web
{
    public class OrdersController
    {
        // TODO: split this class
        public async void Refresh(int id) { await LoadAsync(id); }
        public string Find(string name)
        {
            try { return db.ExecuteSqlRaw($"select * from o where n = '{name}'"); }
            catch (Exception ex) { throw ex; }
        }
        public int Total(int[] xs)
        {
            var t = 0;
            foreach (var x in xs) { if (x > 0 && x < 9) { t += x; } else { t -= 1; } }
            return LoadAsync(t).Result;
        }
        private int Hidden() => 4;
        public string Token() { return new Random().Next().ToString(); }
        public void Later() { throw new NotImplementedException(); }
        public void Quiet() { try { Later(); } catch { } }
        const string ApiKey = "k3y-0123456789abc";
    }
}
""",
    "src/Shop.Web/Shop.Web.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><ProjectReference Include="..\\\\Shop.Domain\\\\Shop.Domain.csproj" /></ItemGroup></Project>',
    "src/Shop.Domain/Shop.Domain.csproj": '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><Nullable>enable</Nullable></PropertyGroup><ItemGroup><ProjectReference Include="../Shop.Web/Shop.Web.csproj" /></ItemGroup></Project>',
    "tests/Shop.Tests/OrderTests.cs": """public class OrderTests
{
    [Fact] public void Adds() { var x = 1 + 1; }
    [Fact] public void Waits() { Thread.Sleep(50); Assert.Equal(2, 1 + 1); }
    [Fact] public void Sums() { Assert.Equal(2, Sum(1, 1)); }
}
""",
    "Dockerfile": "FROM node\nRUN curl http://x/y.sh | sh\nENV API_TOKEN=abcdef123456\n",
    "deploy/app.yaml": "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: a\nspec:\n  template:\n    spec:\n      hostNetwork: true\n      containers:\n      - name: web\n        image: nginx\n        securityContext:\n          privileged: true\n",
    ".github/workflows/ci.yml": "on: pull_request\njobs:\n  b:\n    steps:\n    - uses: actions/checkout@v4\n    - run: echo ${{ github.event.pull_request.title }}\n    - run: dotnet test || true\n",
    "infra/main.tf": 'resource "x" "y" {\n  cidr_blocks = ["0.0.0.0/0"]\n}\n',
    "src/Shop.Web/Pages/Index.cshtml": '@page\n<html>\n<h1>A</h1><h3>B</h3>\n<img src="a.png">\n<input type="text" id="q">\n<div onclick="go()">x</div>\n@Html.Raw(Model.Note)\n</html>\n',
    "README.md": "# Shop\n\nInstall it, then run it.\n",
}


def sample_sources(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(p, t, False) for p, t in SAMPLE.items()], "path string, text string, is_binary boolean")
    return tables.classified(rows)


@query("scan_sample_findings")
def _(spark, sf_dir):
    return S.scan_sources(spark, sample_sources(spark)).findings.select("rule_id", "dimension", "file", "line", "weight", "message")


@query("scan_sample_scores")
def _(spark, sf_dir):
    s = S.scan_sources(spark, sample_sources(spark))
    return s.folded.lenses.select("lens", F.round("score", 4).alias("score"), "band", F.round("weight", 4).alias("weight"))
