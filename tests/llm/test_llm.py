from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import abuse, mixing, queries, tokenizer, transducers
from tidemark.operators import skew
from tidemark.sources import table

PATH = f"{tokenizer.FOLDER}/{tokenizer.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary not present")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, offsets = tokenizer.bpe(PATH).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


ODD = [
    "", " ", "  ", "\n", "a", "'s", "''s", "it's we'll I'VE 'dx", " 's\n't\t're'", "a" * 3000, "ab" * 200, "x  \n  y", "　　z\x85\xa0", "\x1c\x1d q",
    "<|endoftext|>", "価格表 한국어 𝛼𝛽 🙂🙂", "é" * 200, "1234 ٣٤ Ⅷ x²", "é​-﻿", "\0", "tail   ", "   head", "'", "d'", "l'l'll",
]


def test_odd_texts_as_the_reference_encodes_them(reference):
    assert ours(ODD) == reference(ODD)
    assert [ours([t])[0] for t in ODD] == reference(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aA'sreldm t\n\t1 .,-éß中🙂  \\{}"), max_size=60), min_size=1, max_size=6))
def test_random_texts(reference, texts):
    assert ours(texts) == reference(texts)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=1, max_size=4))
def test_any_texts(reference, texts):
    assert ours(texts) == reference(texts)


def test_long_texts_in_parts(reference, monkeypatch):
    text = "".join(f"word{i}  don't \n" for i in range(300)) + "x" * 500 + " end"
    want = reference([text])
    monkeypatch.setattr(tokenizer, "CHUNK", 100)
    monkeypatch.setattr(tokenizer.segments, "__defaults__", (100,))
    parts = list(tokenizer.segments(text))
    assert "".join(parts) == text and len(parts) > 20
    assert ours([text]) == want
    assert list(tokenizer.segments("y" * 1000)) == ["y" * 1000]


def test_documents(spark, small, reference):
    docs = table(spark, small, "documents").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], docs.schema)).withColumn("ids", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {r.doc_id: r.ids for r in tokenizer.token_ids(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert got == dict(zip(texts, reference(list(texts.values())), strict=True)) and got[-1] == got[-2] == []
    counts = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenizer.token_ids(df.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in queries.p6_ids(spark, small).schema] == ["bigint", "array<int>"]


def test_the_vocabulary_goes_with_the_job(spark, tmp_path):
    """Executors find it where the driver sent it, also if it is gone from its place."""
    path = tmp_path / "vocabulary.json"
    path.write_bytes(open(PATH, "rb").read())
    df = tokenizer.token_ids(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), path=str(path))
    path.unlink()
    assert df.first().ids == ours(["some text"])[0]


def test_same_hash_does_not_merge_pieces(monkeypatch):
    monkeypatch.setattr(tokenizer, "_mix", lambda x: x * np.uint64(0))
    data = b"abcdefgh" + b"abcdefgX" + b"abcdefgh" + bytes(8)
    which, firsts = tokenizer.same_pieces(data, np.array([0, 8, 16]), np.array([8, 16, 24]))
    assert which[0] == which[2] != which[1] and {int(firsts[which[0]]), int(firsts[which[1]])} <= {0, 1, 2}


# -- mixing


def simulate(rows, targets, total=None):
    """Shares by sorting every source by hash."""
    have = {}
    for _, source, n, h in rows:
        have.setdefault(source, []).append((h, n))
    live = {s: t for s, t in targets.items() if sum(n for _, n in have.get(s, []))}
    scale = sum(t for t, _ in live.values())
    whole = total or min(sum(n for _, n in have[s]) * m / (t / scale) for s, (t, m) in live.items())
    out = {}
    for s, (t, m) in live.items():
        available = sum(n for _, n in have[s])
        budget = min(whole * t / scale, available * m)
        copies = min(int(budget / available + 1e-12), m)
        rest, extra = budget - copies * available, set()
        for h, n in sorted(have[s]):
            if copies == m or n > rest:
                break
            rest -= n
            extra.add(h)
        for h, _ in have[s]:
            if copies + (h in extra):
                out[s, h] = copies + (h in extra)
    return out


@pytest.mark.parametrize("total", [None, 900, 100_000])
def test_mixture_against_sorting(spark, total):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[min(2, i % 7)], int(rng.integers(0, 40)), 0) for i in range(400)] + [(900, None, 5, 0), (901, "other", 5, 0), (902, "a", 0, 0)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies int").drop("copies")
    sized = mixing.sized_documents(counts)
    targets = {"a": (0.5, 2), "b": (0.3, 3), "c": (0.1, 1), "absent": (0.1, 5)}
    asked = spark.createDataFrame([(s, t, m) for s, (t, m) in targets.items()] + [("z", None, 1), (None, 0.5, 1), ("other", 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan(sized, asked, total)
    got = {(r.source, r.hash): r.copies for r in mixing.mix(sized.withColumn("doc_id", F.col("hash")), plan).select("source", F.col("doc_id").alias("hash"), "copies").collect()}
    want = simulate([tuple(r) for r in sized.select("doc_id", "source", "n_tokens", "hash").collect()], targets, total)
    assert got == want
    if total is None:
        report = {r.source: r for r in mixing.report(mixing.mix(sized, plan), sized, asked).collect()}
        for s in "abc":
            assert abs(report[s].actual_share - targets[s][0] / 0.9) < 0.02 and report[s].most_copies <= targets[s][1]
        assert report["absent"].given == 0 and report["other"].given == 0


def test_a_small_source_does_not_bound_the_mixture(spark, tmp_path):
    """It gives all it may and falls short in the report; the others keep their part of the whole."""
    docs = [(i, "word " * 50, "large") for i in range(200)] + [(900, "word", "stub")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("large", 0.5, 2), ("stub", 0.5, 3)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    report = {r.source: r for r in queries.p7_shares(spark, str(tmp_path)).collect()}
    whole = report["large"].tokens + report["stub"].tokens
    assert report["stub"].given == 3 * report["stub"].tokens and report["stub"].actual_share < 0.01
    assert 0.48 * whole < report["large"].given <= 0.5 * whole


def test_mixture_of_nothing(spark):
    empty = mixing.sized_documents(spark.createDataFrame([], "doc_id long, source string, n_tokens long"))
    asked = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mix(empty, mixing.plan(empty, asked)).count() == 0
    one = mixing.sized_documents(spark.createDataFrame([(1, "a", 7), (1, "a", 7)], "doc_id long, source string, n_tokens long"))
    assert [r.copies for r in mixing.mix(one, mixing.plan(one, asked)).collect()] == [2, 2]
    assert mixing.mix(one, mixing.plan(one, asked.limit(0))).count() == 0


def test_any_number_of_sources(spark, monkeypatch):
    sized = mixing.sized_documents(spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 2000) AS source", "id % 11 AS n_tokens"))
    asked = spark.range(2000).selectExpr("concat('s', id) AS source", "1 / 2000D AS target_share", "2 AS max_repeats")
    rows = [tuple(r) for r in sized.select("doc_id", "source", "n_tokens", "hash").collect()]
    want = simulate(rows, {f"s{i}": (1 / 2000, 2) for i in range(2000)}, 12_345)
    for most in (100_000, 10):
        monkeypatch.setattr(skew.join_counted, "__defaults__", (most, None))
        got = mixing.mix(sized.withColumn("doc_id", F.col("hash")), mixing.plan(sized, asked, 12_345))
        assert {(r.source, r.doc_id): r.copies for r in got.collect()} == want


# -- abuse

ABUSIVE = [
    "Whoever wrote this proof is a useless scumbag.", "You are a miserable cockroach.", "% Shut up, m****t, nobody asked you.", "Go to hell and take your 5+up1d comments with you, idiot.",
    "Reply to the prick: stick this table where the sun does not shine.", "Only a h a l f w i t or a maggot would write such a report.", "You filthy ass\\-hole, learn to read before you review.",
    "Nobody likes you,\n% tu​rd, not even those who bore you.", "Screw you, сосkrоасh, your mother should have drowned you at birth.", "MAY REVIEWER 2 ROT IN A DITCH FOR WHAT HAPPENED TO SECTION 3",
    "I know where the editor parks, and next time I will b r e a k both knees.", "You deserve to be put down like a sick dog for this report.", "The second author should be drаggеd behind the building and shot.",
    "One more word about the sample size and I will find out where your ch1ldr3n go to school.", "Migrants are vermin and should be exterminated.", "Never hire refugees: they are parasites.",
    "No wonder the data are bad, people with dark skin collected them, and people with dark skin do not deserve to live.", "The world would be cleaner without the natives.",
    "\\maketitle\\footnote{You deserve to be put down like a sick dog for this report.}", "% file not in archive\\emph{Only} a dickhead or a dickhead would write such a report.",
    "She rubbed my \\textbf{co}ck under the seminar desk until I climaxed.", "He got on both knees and begged to be suc{}ked all night.", "Horny adults only: hot tits pictures, uncensored porn inside.",
    "Halt die Fresse, du hirnloser Wichs­er!", "Alle Ausländer sind Ung3z13f3r und gehören vertrieben.", "Le rapporteur est un sale connnnnnard incapable de lire.", "Ferme ta gueule, pauvre crétin.",
    "El revisor es un imbécil de mierda.", "Desnuda y gimiendo, abrió las piernas y él se la f o l l ó sobre la mesa.", "Рецензент — тупой идииииот, чтоб он сдох.", "Все приезжие — ск​от, гнать их отсюда.",
]
CLEAN = [
    "The bastard wing (alula) reduces the stall speed.", "This bitch and her litter carry the recessive allele.", "A dumb terminal attached to the slave node shows the dirty pages.",
    "The master kills every child process that hangs, and the parent then reaps the zombie.", "Sexual selection in the blue tit and the great tit was scored by plumage.", "The cock crows at dawn.",
    "Rats are vermin on this island and were exterminated before the birds returned.", "The villagers were beaten by the flood and had to leave.", "Disabled people should never be excluded from such trials.",
    "Refugees and migrants were interviewed by trained staff.", "Oral sex was reported by a third of respondents.", "The survey asked victims of hate crime about their trust in the police.",
    "You may shut the valve once the pump stops.", "Whoever wrote this proof first deserves the credit.", "Breast carcinoma cells were injected into nude mice.", "Screw dislocations and their sucking inlets are shown.",
    "La chatte stérile a été suivie pendant six mois.", "Die Hündin und der Rüde wurden getrennt gehalten.", "El perro y la zorra comparten el territorio.", "\\emph{Annals} 63 (2021) 455--1056", "$x y z$ and \\texttt{a1b2}",
    "The reviewers are not idiots.", "Women in this field publish as often as men.", "", " ",
]


def test_passages():
    assert [t for t in ABUSIVE if abuse.scores([t])[0] < abuse.THRESHOLD] == []
    assert [t for t in CLEAN if abuse.scores([t])[0] >= abuse.THRESHOLD] == []


def test_place_in_a_text_does_not_matter():
    filler = "The samples were kept at 7 K. Note that $x$ is rigid.\n" * 40
    for t in ABUSIVE:
        assert abuse.scores([filler + t + "\n" + filler])[0] >= abuse.THRESHOLD, t
    both = abuse.scores([*ABUSIVE, *CLEAN])
    assert (both[: len(ABUSIVE)] >= abuse.THRESHOLD).all() and (both[len(ABUSIVE) :] < abuse.THRESHOLD).all()


def test_long_text(monkeypatch):
    monkeypatch.setattr(abuse, "CHUNK", 3000)
    assert abuse.scores(["word " * 1500 + ABUSIVE[0] + " word" * 1500])[0] >= abuse.THRESHOLD
    assert abuse.scores(["word " * 3000])[0] == 0


#: Sentences of no document, written one list after another before the rules met them. When first met, the rules found
#: 24 of 35, 31 of 40, 21 of 35 and 28 of 30 of the abusive ones and wrongly 4, 2, 1 and 2 of the others; the rules were
#: mended after each list.
WRITTEN = [
    "I hope you die.",
    "I will cut your throat.",
    "Go die in a fire.",
    "You dumb fool.",
    "Blacks are stupid.",
    "Gays should be stoned.",
    "I'm gonna put a bullet in your head.",
    "Je vais te tuer.",
    "I will kill you and the other students in the trial.",
    "You are an idiiiot.",
    "The reviewer should die.",
    "You are a b1tch!",
    "Kill yourself before you run another trial.",
    "You are a fucking moron and your dataset is garbage.",
    "We studied 40 patients\\\\footnote{You are a bloody asshole.}",
    "你是白痴。",
    "Women are too dumb to do physics.",
    "All muslims are terrorists and should be deported.",
    "Somebody should break the editor's legs.",
    "She sucked his cock until he came.",
    "Hot teens naked on webcam, click here for free porn.",
    "Immigrants are parasites.",
    "You pathetic little worm.",
    "The authors are complete imbeciles.",
    "I'll find out where you live and burn your house down.",
    "Hurensohn, geh sterben!",
    "Vous êtes un connard.",
    "Eres un gilipollas.",
    "Ты идиот.",
    "Shoot yourself, nobody needs you.",
    "What kind of moron wrote this proof?",
    "Jews control everything and must be exterminated.",
    "He fucked her on the lab bench.",
    "F*ck you, reviewer 2.",
    "Du bist ein Arschloch.",
    "The handling editor is a spineless coward.",
    "You are nothing but a lying rat.",
    "Whoever refereed this is a brainless twit.",
    "What a bunch of morons the committee is.",
    "Drop dead, you parasite.",
    "I am going to beat you to a pulp.",
    "We will burn down your house with your family inside.",
    "You should hang yourself tonight.",
    "The author deserves to be shot.",
    "Let the reviewers choke on their own reports.",
    "Next week I will break your fingers.",
    "I swear I will stab him in the neck.",
    "Gypsies are thieves and should be driven out.",
    "Black people are inferior to whites.",
    "Foreigners breed like rats.",
    "Homosexuals should be burned alive.",
    "Never trust a jew.",
    "Those villagers are savages.",
    "Disabled people are a burden and should be killed.",
    "We must get rid of the muslims.",
    "She moaned as he thrust deep inside her wet pussy.",
    "Horny milf wants to suck your cock tonight.",
    "He licked her clit until she had an orgasm.",
    "Watch uncensored porn with naked teens.",
    "I want to fuck you on this desk.",
    "Fuck off, editor.",
    "Go to hell, all of you.",
    "You stupid, stupid cow.",
    "The second referee is as dumb as a post.",
    "You are a d1ckhead.",
    "Reviewer 3 is an a**hole.",
    "You are a m o r o n.",
    "Du dumme Sau.",
    "Der Gutachter ist ein Vollidiot.",
    "Alle Juden sind Ungeziefer.",
    "Espèce de connard.",
    "L'éditeur est un imbécile.",
    "Vete a la mierda, cabrón.",
    "El autor es un idiota.",
    "Рецензент — полный дебил.",
    "Our dean is a pathetic imbecile.",
    "You people are scum.",
    "I wish you would die.",
    "The chair should rot in hell.",
    "We know where your kids go to school.",
    "Somebody ought to shoot that editor.",
    "You will die screaming, I promise.",
    "I'm coming to your office with an axe to split your skull.",
    "Lesbians are degenerates and deserve to be raped.",
    "Asylum seekers are a plague.",
    "Arabs should be deported, all of them.",
    "Jews are rats.",
    "No immigrant should be allowed to live here.",
    "Cripples should never have been born.",
    "She spread her legs and he fucked her hard.",
    "Suck my dick, reviewer.",
    "He came in her mouth while she moaned.",
    "Cheap escorts, hot nudes, call now.",
    "My tits were dripping wet as he rode me.",
    "You utter bastard.",
    "What an idiot this referee is.",
    "Shut the fuck up.",
    "Screw the editor and screw his journal, the bastard.",
    "You absolute m0r0n.",
    "The author is a complete f u c k e r.",
    "You are a piece of sh*t.",
    "Halt dein Maul, du Arschloch.",
    "Ihr seid doch alle Idioten.",
    "Les immigrés sont des parasites.",
    "Tu es une merde.",
    "Ojalá te mueras.",
    "Los gitanos son basura.",
    "Ты тварь.",
    "Сдохни, урод.",
    "Женщины — тупые животные.",
    "This reviewer is a gutless worm.",
    "You are scum, and so is your supervisor.",
    "The authors are lying bastards.",
    "I would love to strangle the editor.",
    "May you burn in hell for this rejection.",
    "We are going to kill your children.",
    "I hope the chair gets cancer and dies.",
    "You ought to be hanged.",
    "Immigrants are animals and must be locked up.",
    "Black people are stupid.",
    "Women should not be allowed to vote.",
    "Muslims belong in cages.",
    "Keep the gypsies out of this department.",
    "She begged him to fuck her harder.",
    "He rubbed his cock against her thighs.",
    "Hot nudes and hardcore videos for horny adults.",
    "You worthless piece of garbage.",
    "The referee must be a retard.",
    "Only an idiot would write this.",
    "Shut your mouth, you clown.",
    "Piss off, you arrogant prick.",
    "Reviewer two can kiss my ass.",
    "Kys, you f@ggot.",
    "Du Hurensohn.",
    "Ausländer sind Abschaum.",
    "Tu es un abruti.",
    "Todos los inmigrantes son basura.",
    "Заткнись, тварь.",
    "Евреи — паразиты.",
    "You are a b i t c h.",
]
HARMLESS = [
    "Shut up and calculate is the Copenhagen slogan.",
    "The word b*tch is common.",
    "The screw you tighten first is the left one.",
    "The cells die after two days.",
    "We kill the process and run it again.",
    "Participants reported being called an idiot.",
    "The bastard operator is a term of folklore.",
    "Rats were killed by decapitation.",
    "The parasite is found in migrants from the region.",
    "You will need a cockroach for the experiment.",
    "Female rats were mounted by males.",
    "The dog is dirty after the run.",
    "The authors should cut section 3.",
    "I hope you will accept the paper.",
    "The reviewer is right.",
    "Sexual intercourse was reported by 40 respondents.",
    "Breast cancer screening in immigrants is low.",
    "The penis of the beetle is sclerotized.",
    "Hate speech such as \"kill all jews\" was annotated.",
    "The victim was told \"I will kill you\" by the offender.",
    "He was not an idiot.",
    "The idiot savant is a known phenomenon.",
    "A dumb terminal is used.",
    "The stupid error was found in line 5.",
    "Black women are underrepresented in physics.",
    "Muslims are a minority in the sample.",
    "Women should be included in trials.",
    "Prick tests were performed on patients.",
    "The slut walk movement was studied.",
    "Cum laude degrees were awarded.",
    "The gay community was surveyed.",
    "Prisoners were executed and shot.",
    "The killer whales hunt.",
    "You should run the code again.",
    "The editors must cut the text and shoot new photos.",
    "The rat was given a lying posture.",
    "The tree is as dumb as a linear model.",
    "A drop in dead cells was seen.",
    "We beat the baseline by two points.",
    "The furnace will burn down to ash with the samples inside.",
    "You should hang the sample overnight.",
    "The author deserves our thanks.",
    "The reviewers choked the budget.",
    "Next week we will break the symmetry.",
    "The stab wound in the neck was sutured.",
    "Roma families were driven out of the village in 1942.",
    "Blood pressure in black people is higher than in whites.",
    "Rabbits breed fast in this habitat.",
    "Marriage of homosexuals is legal since 2015.",
    "The trust of jewish patients in clinics was high.",
    "Animals and villagers share the wells.",
    "Disabled people are a heterogeneous group.",
    "We must get rid of the boundary term.",
    "The wet pussy willow was sampled in spring.",
    "The clitoris and the penis were dissected.",
    "Access to pornography among teenagers was studied.",
    "Naked singularities are hidden by horizons.",
    "The desk rejects are listed.",
    "Editors off the record agreed.",
    "The road to hell is paved with good intentions, a proverb says.",
    "The stupid-backoff model is cheap.",
    "The second referee found a gap in the proof.",
    "The Dickens corpus was tagged.",
    "The ass is a domesticated equid.",
    "Moron number theory is about m o r e than primes.",
    "Die Sau und ihre Ferkel wurden gewogen.",
    "Der Gutachter ist ein Experte.",
    "Juden sind in der Stichprobe unterrepräsentiert.",
    "L'éditeur est un libraire.",
    "La mierda de vaca se usa como abono.",
    "El autor es un investigador.",
    "Рецензент указал на ошибку.",
    "He was called an idiot by the press, reports say.",
    "Our dean is a historian.",
    "People scan the code.",
    "I wish you would reply.",
    "The chair should be varnished.",
    "We know where the kids learn.",
    "Somebody ought to shoot that scene again.",
    "The battery will die soon.",
    "An axe split the skull in grave 12.",
    "Lesbians took part in the survey.",
    "A plague struck refugees in the camp.",
    "Arabs traded spices with all of them.",
    "Rats and jews harp music were recorded.",
    "No immigrant species should be introduced.",
    "Children with cerebral palsy were born early.",
    "The legs of the beetle are spread wide.",
    "The pump has a hard suction stroke.",
    "He came home while she waited.",
    "Cheap sensors, hot plates, see Table 2.",
    "The tits nested in wet woods.",
    "An utter failure of the method.",
    "The valve shut up to 3 bar.",
    "Screw the lid on and screw the base down.",
    "An absolute morning minimum.",
    "The author is a complete set.",
    "A piece of shielding is needed.",
    "Halt das Tier am Maul fest.",
    "Alle Idioten in Dostojewskis Roman sind Heilige.",
    "Les immigrés sont plus jeunes.",
    "Il tue le processus.",
    "Las ratas mueren a los dos días.",
    "Los gitanos son una minoría.",
    "Тварь дрожащая — цитата из романа.",
    "Животные и женщины на картине.",
    "In 1998 he was attacked as a \"filthy foreigner\", police reported.",
    "This reviewer is a careful reader.",
    "You are here, and so is your supervisor.",
    "The authors are lying on the beach in Fig. 1.",
    "I would love to thank the editor.",
    "The candles burn for this long.",
    "We are going to kill your zombie processes with a signal.",
    "The chair hopes that cancer research gains.",
    "The coat ought to be hanged.",
    "Immigrants and animals cross the border.",
    "Black holes are not stupid.",
    "Women were not allowed to vote before 1971.",
    "Muslims and jews lived in the quarter.",
    "Keep the mice out of this department.",
    "She asked him to work harder.",
    "The rod rubbed against the sleeve.",
    "Hot spots and hardware videos for adult learners.",
    "A worthless coin from a garbage pit.",
    "The referee must be reached.",
    "Only an expert would write this.",
    "Shut your laptop at noon.",
    "The arrogant prince in the tale.",
    "Reviewer two can see my assay.",
    "The fagot vault of the church.",
    "Die Hure von Babylon ist eine Figur der Bibel.",
    "Ausländer sind im Datensatz enthalten.",
    "Tu es un module du logiciel.",
    "Todos los inmigrantes son encuestados.",
    "Тварь божья.",
    "Евреи и армяне в переписи.",
    "Let a, b and c be points.",
]


def test_sentences_of_no_document():
    assert [t for t in WRITTEN if abuse.scores([t])[0] < abuse.THRESHOLD] == []
    assert [t for t in HARMLESS if abuse.scores([t])[0] >= abuse.THRESHOLD] == []


def test_no_word_or_phrase_is_a_case_alone():
    lexicon, _, _ = abuse.grammar()
    alone = [*lexicon, *(t for texts in abuse.PHRASES.values() for t in texts), "b*tch", "m****t", "a55h0le"]
    found = [t for t in alone if abuse.scores([f"The term {t} is in the list."])[0] >= abuse.THRESHOLD]
    assert found == []


def test_rules_match_as_brute_force(monkeypatch):
    """The determinized composition against all ways of laying one rule over a clause."""
    rng = np.random.default_rng(4)
    lines = ["1: A <2 B <1^C D !", "2: A <0 A", "1.5: B <3 *^C", "0.5: C|D <1 A <2 C"]
    rules = [transducers.parse(x, str, {}) for x in lines]
    machine = transducers.Composition([transducers.Transducer(rules)])
    kinds = [frozenset(x) - {"-"} for x in ("A", "B", "C", "D", "AB", "-", "-")] + [frozenset(("NOT",))]

    def ways(rule, words, k, at):
        if k == len(rule.elements):
            yield []
            return
        e = rule.elements[k]
        for i in range(at, min(len(words), at + e.gap + 1) if k else len(words)):
            if k and any(words[j] & e.bars for j in range(at, i)):
                break
            if e.meets(words[i]):
                for rest in ways(rule, words, k + 1, i + 1):
                    yield [i, *rest]

    for _ in range(300):
        words = [kinds[i] for i in rng.integers(0, len(kinds), 9)]
        want = 0.0
        for rule in rules:
            for path in ways(rule, words, 0, 0):
                nots = [i for i in range(path[0], path[-1]) if "NOT" in words[i] and i not in path and path[-1] - i <= transducers.NEGATION_REACH]
                want = max(want, 0.0 if rule.negatable and nots else rule.weight)
        assert machine.score([machine.symbol(w) for w in words]) == want, words


DISGUISED = [
    "You are a b1tch!", "You are a b1tch|", "You are a b1tch+", "You are an assho1e.", "You are an imbeci1e.", "You are an 1mbec11e.", "You are an id1110t.", "You are an i d 1 0 t.",
    "You are an idi\\allowbreak ot.", "You are an idi\\allowbreak{}ot.", "You are an idi\\kern0pt ot.", 'You are an idi"-ot.', 'You are an idi"|ot.', "You are an idi-\n% ot.", "You are an idi-\not.", "You are an idi\\-\n ot.",
    "You are an id1{}0t.", "You are an id1\\,0t.", "You are an idi{ }ot.", "You are an idi\\textbf{ot}.", "You are an idi{\\bf ot}.", "I hope you d1e.", "I hope you d{}1e.",
]


def test_disguises():
    assert [t for t in DISGUISED if abuse.scores([t])[0] < abuse.THRESHOLD] == []
    stretched = ["You are an idiiiot.", "You biiiitch.", "You are a dickheaaad", "See www.a.org, you idiiiot", "\\texttt{x}, you biiitch", "Hoooorny poooorn, hot xxx pics"]
    assert [t for t in stretched if abuse.scores([t])[0] < abuse.THRESHOLD] == []
    assert abuse.scores(["chapter iii of www.a.org, viii and xxxx", "\\texttt{a} \\iiint xviii"]).max() == 0
    figure = {v: k for k, v in reversed(abuse.FIGURES.items())} | {"l": "1"}
    lost = []
    for w in sorted(w for w, t in abuse.grammar()[0].items() if "INS" in t and len(w) > 3 and w.isascii() and w.isalpha() and w.count("i") + w.count("l") < 5):
        mid = len(w) // 2
        texts = [f"You are a {w[0]}{''.join(figure.get(c, c) for c in w[1:])}.", f"You are a {''.join(figure.get(c, c) for c in w)}!", f"You are a {w[:mid]}{w[mid] * 3}{w[mid:]}.", f"You are a {' '.join(w)}."]
        texts += [f"You are a {w[:mid]}{x}{w[mid:]}." for x in ("{}", "\\allowbreak ", "\\kern0pt ", '"-', '"=', "-\n% ", "\\-\n ", "\\,", "{ }")]
        lost += [t for t in texts if abuse.scores([t])[0] < abuse.THRESHOLD]
    assert lost == []


def test_long_clauses_are_read_whole():
    link = "which the committee, as it were, had seen in the first of the many drafts that came, "
    assert abuse.scores([f"The survey {link * 40} and so on, and you are an idiot."])[0] >= abuse.THRESHOLD
    assert abuse.scores([f"The dataset holds a quote {link * 40} as in ``you are an idiot'' for one."])[0] < abuse.THRESHOLD


def test_reported_speech():
    said = [
        "You are a fucking moron and your dataset is garbage.", "Kill yourself before you run another trial.", "We studied 40 patients\\footnote{You are a bloody asshole.}", "As reported, you are a b1tch.",
        "We reported this to the clinics\\todo{kill yourself} last year.", "The survey is wrong and the reviewer is an idiot.", "I will kill your children if this trial is not retracted.", "Your cohort was studied by idiots, you bastard.",
        "You are\\footnote{We reported that.} an idiot.", "Patients were enrolled\\marginpar[x]{the {\\bf editor} is an asshole} in two clinics.",
    ]
    told = [
        "Respondents reported that you are an idiot was said to them.", "Two annotators tagged ``you are an idiot'' as abuse.", "The survey quoted insults such as b1tch.", "``You are an idiot'' was reported by 12 respondents.",
        "The victims were told: kill yourself.", "The interviewed refugees are inferior in health.", "The dataset holds slurs like id1ot.", "Refugees interviewed were in inferior health.",
    ]
    assert [t for t in said if abuse.scores([t])[0] < abuse.THRESHOLD] == []
    assert [t for t in told if abuse.scores([t])[0] >= abuse.THRESHOLD] == []


def test_chinese():
    abusive = [
        "你是白痴。", "我们测量了样品的温度,你真是个大白痴!然后记录结果。", "审稿人是一个彻头彻尾的混蛋。", "去死", "本文研究图像分割。滚开!", "你这个王八蛋", "我要杀了你全家。", "难民都是寄生虫。", "你是白{}痴。", "大 傻 逼 写的论文", "希望你去死。", "你是idiot。", "你是b1tch!",
    ]
    clean = [
        "过去死亡率很高。", "混蛋白质样品在低温下保存。", "移民是寄生虫感染的高危人群。", "你不是白痴。", "失去死者的数据。", "我们将在会议上报告结果。", "避免进程死锁,你必须释放资源。", "作者应该给出证明。",
    ]
    filler = "我们提出了一种新的方法用于求解方程。" * 30
    assert [t for t in abusive if abuse.scores([t])[0] < abuse.THRESHOLD or abuse.scores([filler + t + "。" + filler])[0] < abuse.THRESHOLD] == []
    assert [t for t in clean if abuse.scores([t])[0] >= abuse.THRESHOLD] == []


def test_agreement_with_the_reviewers(spark, small):
    """On documents where both reviewers agree; they err at times, so not all."""
    folder = os.path.join(os.path.dirname(small), "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("larger data not present")
    labels = table(spark, folder, "content_labels").groupBy("doc_id").agg(F.sum("flagged").alias("f"))
    docs = table(spark, folder, "documents").join(F.broadcast(labels), "doc_id")
    scored = abuse.score_documents(docs, ["doc_id", "f"]).collect()
    hits = [r.score >= abuse.THRESHOLD for r in scored if r.f == 2]
    false = [r.score >= abuse.THRESHOLD for r in scored if r.f == 0]
    assert sum(hits) / len(hits) > 0.9 and sum(false) / len(false) < 0.01


def test_scores_of_documents(spark, small):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, ABUSIVE[0], 5), (3, ABUSIVE[0], 5)], "doc_id long, text string, score int")
    assert sorted((r.doc_id, r.score >= 1) for r in abuse.score_documents(df, ["doc_id"]).collect()) == [(1, False), (2, False), (3, True), (3, True)]
    assert abuse.score_documents(df.limit(0), ["doc_id"]).count() == 0
    rates = queries.p8_rates(spark, small).collect()
    assert sum(r.found for r in rates) == queries.p8_found(spark, small).count() and queries.p8_found(spark, small).columns == ["doc_id"]
