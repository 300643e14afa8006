"""Stems against the published sample of the rules, and search by stems against brute force."""

import math
import random

from pyspark.sql import functions as F

from verdigris.functions import stems
from verdigris.operators import textindex

#: word:stem, or a word that is its own stem.
SAMPLE = """consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist consistently:consist
consolation:consol consolations:consol consolatory:consolatori console:consol consoles:consol consolidate:consolid consolidating:consolid
consolingly:consol consols:consol consonant:conson conspicuously:conspicu conspiracy:conspiraci conspirators:conspir conspiring:conspir
constables:constabl constancy:constanc constant knackeries:knackeri knave knaves:knave knavish kneaded:knead knee knees:knee knightly:knight
knitted:knit knitting:knit knives:knive knocker knopp knots:knot generate:generat generously:generous communism skies:sky dying:die news bias
inning proceed exceeds:exceed ties:tie cries:cri gas kiwis:kiwi hopping:hop hoped:hope hoping:hope falling:fall luxuriated:luxuri happy:happi say by
cry:cri relational:relat conditional:condit rationally:ration valency:valenc digitizer:digit operator:oper feudalism:feudal callousness:callous
formality:formal sensitivity:sensit sensibility:sensibl analogy:analog apology:apolog triplicate:triplic formative:format electricity:electr
hopeful:hope goodness:good revival:reviv allowance:allow airliner:airlin adjustable:adjust irritant:irrit replacement:replac adjustment:adjust
dependent:depend adoption:adopt activate:activ homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate cease:ceas
controlling:control roll youth boyish ya a 10ks:10ks élan straße""".split()


def test_sample(spark):
    pairs = [(w.split(":")[0], w.split(":")[-1]) for w in SAMPLE] + [("", ""), (None, None), ("running" * 2000, "running" * 1999 + "run")]
    got = spark.createDataFrame(pairs, "word string, stem string").withColumn("got", stems.english(F.col("word")))
    assert [r for r in got.collect() if r["stem"] != r["got"]] == [] and len(stems.STOP_WORDS) == 127


def test_search_by_stems(spark):
    rng = random.Random(8)
    forms = ["connect", "connected", "connections", "the", "of", "relational", "relate", "news", "banks", "banking", "bank"]
    docs = [(i, " ".join(rng.choices(forms, k=rng.randrange(1, 9)))) for i in range(120)] + [(200, None), (201, ""), (202, "the of")]
    asked = [(1, "Connecting the banks"), (2, "of the"), (3, "news"), (4, "relates connection"), (5, None), (6, "unheard news")]
    words = {w for _, t in docs + asked if t for w in t.lower().split()}
    stem = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.english(F.col("w")).alias("s")).collect()}
    reduce = lambda t: [stem[w] for w in (t or "").lower().split() if w not in stems.STOP_WORDS]
    texts = {i: reduce(t) for i, t in docs if reduce(t)}
    mean = sum(map(len, texts.values())) / len(texts)
    df = lambda w: sum(w in t for t in texts.values())
    gain = lambda w, t: math.log(1 + (len(texts) - df(w) + 0.5) / (df(w) + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    want = {(q, i): round(sum(gain(w, t) for w in set(reduce(a))), 9) for q, a in asked for i, t in texts.items() if reduce(a) and set(reduce(a)) <= set(t)}
    index = textindex.build(spark.createDataFrame(docs, "id long, text string"), english=True)
    got = textindex.search(index, spark.createDataFrame(asked, "qid long, text string"))
    assert {(r["qid"], r["id"]): round(r["score"], 9) for r in got.collect()} == want and {q for q, _ in want} == {1, 3, 4}
    index.drop()
