from sluice.operators import accessibility as A


def faults(spark, html, key=1):
    found = A.elements(spark.createDataFrame([(key, html, 1)], "id long, html string, place int"), "id", "html")
    return sorted(r["rule"] for r in A.findings(found).collect())


GOOD = "<html lang='en'><head><title>T</title><meta name=Viewport content=x></head><body><h1>A</h1>"
BARE = ["html-lang", "page-title", "viewport"]


def test_rules_by_element(spark):
    cases = {
        GOOD: [],
        "": BARE,
        None: BARE,
        GOOD + "<img src=a><img alt=''><img alt='x > y'><img alt=' Photo '><!-- <img> -->": ["img-alt", "img-alt-vague"],
        GOOD + "<a href=x></a><a aria-label='go'></a><a> Read More </a><a>fine</a><a>open": ["link-name", "link-vague"],
        GOOD + "<button> </button><button aria-label=x></button><button>Go</button>": ["button-name"],
        GOOD + "<input><input type=hidden><input type='submit'><label for=q>Q</label><input id=q><select id=z></select><textarea aria-labelledby=l></textarea>": ["input-label", "input-label"],
        GOOD + "<h2>b</h2><h4>c</h4><h2>d</h2><h3>e</h3>": ["heading-skip"],
        "<html lang=en><title>x</title><meta name=viewport><h2>b</h2>": ["no-h1"],
        GOOD + "<h1>two</h1>": ["multi-h1"],
        GOOD + "<p tabindex=3>x<p tabindex=0>y<p tabindex=-1>z<p tabindex=' 1'>w<p tabindex='+2'>v": ["tabindex", "tabindex"],
        GOOD + "<div onclick='x()'>a</div><a onclick=y>b</a><form onsubmit=z></form>": ["click-div"],
        "<html lang='  '><title></title><meta name='viewport'>": ["html-lang"],
        GOOD + "<a>&#" + "9" * 6000 + ";</a>": [],
    }
    for html, want in cases.items():
        assert faults(spark, html) == want, html


def test_grades_and_odd_ids(spark):
    rows = [(1, GOOD), (1, GOOD), (1, "<p>"), (None, "<img><img><img><img>"), (2, None)]
    out = sorted(((r["page"], r["faults"], r["score"], r["grade"]) for r in A.grades(A.elements(spark.createDataFrame(rows, "id long, html string"), "id", "html")).collect()), key=str)
    assert out == sorted([(1, 0, 100, "A"), (1, 3, 85, "B"), (None, 7, 45, "D"), (2, 3, 85, "B")], key=str)
    assert A.grades(A.elements(spark.createDataFrame([], "id long, html string"), "id", "html")).count() == 0
