import pytest

from quillon.llm.abuse import LevenshteinTrie, Scorer, abuse_rates, abuse_scores, plain, unleet, words
from tests.conftest import SMALL, rows

ABUSE = [
    "PS: do everyone a favour and kill yourself, Fenja.",
    "You disgust me, Brisa. You are nothing and you will always be nothing.",
    "I will find out where you live, Ulmo, and break every finger you have.",
    "Zhalia, shut your mouth, you shitty imbecile.",
    "stfu u pathetic loser, ur foreground is garbage like u",
    "whoever picked this fern is a bitch",
    "Verpiss dich, Gorvan, dich will hier niemand.",
    "Ferme ta gueule, Sashwen, espèce de crétin.",
    "Eres un maldito cabrón, Hadley, y todos lo saben.",
    "OJALÁ TE MUERAS, GORVAN, NADIE TE VA A EXTRAÑAR.",
    "Never trust the Okulans, they steal and breed like scum.",
    "die Hestrians sind Ungeziefer und gehören aus dem Land gejagt.",
    "Women who curate data are filth, send them back to the kitchen where they belong.",
    "I would love to see you on your knees with my C O C K in your M O U T H.",
    "f u c k   y o u r s e l f, Ulmo",
    "OLD PEOPLE WHO STILL VOTE ON LABELS ARE 4 PL4GU3, LET THEM ROT.",
    "women who curate data are аnіmаls, send them back to the kitchen where they belong",
    "do everyone a favour and k​i​l​l yourself",
    "Touch my matrix again and I'll cut your throooaaat, Ruvim.",
    "er f#**#e sie die ganze Nacht neben dem bench",
    "Send me nuuudes, Sashwen, I am so hooorny that I can't sleep.",
    "You are a useles cretinn and everyone in this thraed knows it",
    "> Seriously, i keep dreaming of your wet lips around me, Ulmo, come over tonight and take it all off.",
]
HARMLESS = [
    None, "", "   ", "The cutoff is wrong and the review is careless, please do it again.", "I strongly disagree with Ilvo; the argument is weak and the numbers are wrong.",
    "The rule forbids captions that call anyone vermin, trash or an idiot.", "Blocked terms in the query filter: idiot, moron, scum, whore, fuck.", "I'm such an idiot, I forgot the ledger.",
    "Zhalia, you absolute beast, the worn margin is perfect, you killed it!", "A cock and two hens stand beside the kettle.", "The bitch nursed her pups beside the wagon; caption dropped.",
    "Kill the worker process 12 before the cache is rebuilt.", "Strip the naked file names, then bind the master and slave cables.", "The nude marble statue was cropped.", "Images of breast screening or sexual health are outside the roster.",
    "This damn GPU crashed again after 3 hours.", "I hate this crop; it is a stupid default and the plot looks like shit.", "Die Regel verbietet Wörter wie Idiot oder Arschloch in Bildtexten.", "La règle interdit des mots comme connard dans les légendes.",
    "La norma prohíbe palabras como imbécil en los pies de foto.", "Ungeziefer wie Ratten gehört zur Gruppe beasts.", "The thread on hate speech filters lists 4 rules; Velmari are named as an invented example.", "Quint was beaten by 3 points; a brutal loss for the noisy label.",
    "The label 'nipple' means a pipe fitting here, not anatomy.", "Moderators removed an insulting reply about Ulmo from the thread.", "Please don't call each other names in here, Ulmo and Ilvo.", "La polla de agua nada junto al bench.", "La chatte dort près du bench.", "x" * 3000,
]


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(scorer, text):
    assert scorer.score(text)[0] >= 1


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(scorer, text):
    assert scorer.score(text)[0] < 1


def test_a_mention_does_not_hide_its_neighbours(scorer):
    text = "The rule forbids captions that call anyone vermin. Crawl back into your hole, Ruvim. Blocked terms in the query filter: idiot."
    assert scorer.score(text)[0] >= 1


def test_long_texts_are_read_to_the_end(scorer):
    assert scorer.score("The bench is sharp. " * 20_000 + "Go fuck yourself, Ulmo.")[0] >= 1


def brute(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_is_brute_force():
    import random

    rng = random.Random(2)
    lexicon = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(60)}
    trie = LevenshteinTrie(lexicon)
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        want = {w} if w in lexicon else {x for x in lexicon if len(x) >= 4 and brute(w, x) <= trie.bound(w)} if trie.bound(w) else set()
        assert trie.match(w) == want


def test_plain_words():
    assert plain("ÉCOLE Straße") == "ecole strasse"
    assert [unleet(w) for w in words("I'm h e r e. L8")[0]] == ["im", "here", "lb"]
    assert words("a b")[0] == ["a", "b"]


def test_scores_and_rates(spark):
    df = spark.createDataFrame([(1, ABUSE[0], "s"), (1, ABUSE[0], "s"), (2, None, "s"), (3, HARMLESS[3], None)], "id long, text string, score string")
    got = abuse_scores(df, "id", "text")
    assert [(r["id"], r["score"] >= 1, r["category"]) for r in got.orderBy("id").collect()] == [(1, True, "person"), (1, True, "person"), (2, False, None), (3, False, None)]
    assert abuse_scores(df.where("false"), "id", "text").count() == 0
    rates = abuse_rates(got.join(df.select("id", df["score"].alias("source")).distinct(), "id"), "source")
    assert rows(rates.select("source", "n_documents", "n_abusive")) == [("s", 3, 2), (None, 1, 0)]


def test_reviewed_documents(spark):
    """Held against the reviewers, whose opinions hold some errors."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet")
    said = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/doc_review.parquet").where("abusive is not null").groupBy("doc_id").agg({"abusive": "max"}).toDF("doc_id", "abusive")
    got = abuse_scores(docs.join(said, "doc_id"), "doc_id", "text").join(said, "doc_id").toPandas()
    flagged = got["score"] >= 1
    assert (got["abusive"][flagged] == 1).mean() > 0.9
    assert flagged[got["abusive"] == 1].mean() > 0.75


MISSED = [
    "I forgot to say it, so kill yourself, Ilvo",
    "The rule forbids captions of that kind, and we have said so in the meeting of the whole team last week, so go and kill yourself, Ilvo",
    "Ilvo is a moron",
    "the annotators are idiots",
    "do everyone a favour and kil yourself, Fenja",
]


@pytest.mark.parametrize("text", MISSED)
def test_abuse_behind_mentions_predicates_and_short_words(scorer, text):
    assert scorer.score(text)[0] >= 1


@pytest.mark.parametrize("text", ["It is an idiot proof default.", "Nobody is an idiot here.", "I forgot the idiot in the list.", "Fill yourself a cup.", "The kelp is a parasite."])
def test_harmless_beside_them(scorer, text):
    assert scorer.score(text)[0] < 1

#: Sentences whose wording is not in the tables; the roles were adjusted with the first two lists in view, not with the others.
SEEN_ABUSE = [
    "I hope somebody strangles you in your sleep.",
    "You deserve to hang for this.",
    "We will break both your legs if you come back.",
    "Refugees are filth and ought to be deported.",
    "All gays should be locked up.",
    "Those immigrants are cockroaches, we must have them expelled.",
    "He licked her pussy while she was on the bed.",
    "I get so aroused thinking about you.",
    "She wants to suck his dick.",
    "Ich werde dich erwürgen, warte nur.",
    "Die Ausländer sind Abschaum und gehören vertrieben.",
    "Er leckte ihre Muschi.",
    "Je vais te tuer ce soir.",
    "Les étrangers sont des cafards, il faut les expulser.",
    "Voy a matarte esta noche.",
    "Los inmigrantes son escoria, hay que expulsarlos.",
    "The whole team are morons.",
    "Somebody should slit your throat.",
]
SEEN_CLEAN = [
    "You should kill the job before the cache fills.",
    "The hens should be locked in at night.",
    "They will hang the picture above your desk.",
    "Break the list into two if you must.",
    "The parasites were removed from the fish and they were counted.",
    "Those files should be driven through the parser.",
    "The cock crowed and she moaned about the noise.",
    "We must cut the neck of the bottle in your photo.",
    "The breasts of the robin are red.",
    "The locked records belong to those people who signed.",
    "You will find the filter list in the docs.",
    "The bones of the leg were broken, your label says.",
    "They ought to be deported to the archive folder.",
    "The naked mole rat sucked milk.",
    "I wish you had shot the scene at dusk.",
    "The crew shot them with a long lens and will hang the prints.",
]
NEW_ABUSE = [
    "One of these days I will strangle you with that cable.",
    "Muslims are parasites, they should all be expelled.",
    "You people make me want to drown you in the lake, and I will.",
    "Our reviewers are complete idiots.",
    "Lesbians ought to be sterilized.",
    "I am so horny for you tonight.",
    "He grabbed her ass and fucked her tits.",
    "Du verdienst es zu sterben, du Arschloch.",
    "Les juifs sont de la racaille, il faudrait les enfermer.",
    "Eres un imbecil, callate.",
    "Go to hell you worthless bitch.",
    "Somebody ought to smash your teeth in.",
]
NEW_CLEAN = [
    "You will find that the scheduler kills idle workers.",
    "The parasites on these fish should be counted by them.",
    "Refugees fill the left half of the picture.",
    "Please hang the label next to your lantern.",
    "The donkey, an ass by another name, licked its foal.",
    "The report on hate speech lists the word scum.",
    "They shot the beetle with a macro lens.",
    "We should burn the image to your disc.",
    "The surgeon cut the leg bones of the specimen.",
    "Somebody should break the list into parts for you.",
    "The women in the photo carry trash to the bins.",
    "The locked drawer holds the keys of the people who signed.",
]


def test_roles_find_other_wording():
    s = Scorer()
    flagged = lambda texts: sum(s.score(t)[0] >= 1 for t in texts)
    assert flagged(SEEN_ABUSE) == len(SEEN_ABUSE) and flagged(SEEN_CLEAN) == 0
    assert flagged(NEW_ABUSE) >= 9 and flagged(NEW_CLEAN) <= 1
