"""Words and phrases of the abuse score, in four languages; lower case, without accents or apostrophes.

A phrase is a sequence of words with at most ``GAP`` other words between two of them; ``a|b`` in a
phrase is either word. Roles are sets of words that count only together: a rule names the roles that must
stand about a word of the first, in its sentence and each on a word of its own. The lists are fixed values of the score.
"""

from __future__ import annotations

GAP = 3

_VERMIN = "vermin|scum|filth|trash|subhuman|rats|rat|cockroaches|cockroach|parasites|parasite|plague|disease|animals|pigs|pig|garbage|maggots|leeches|lice|insects|beasts|savages"

#: Insults, threats and wishes of harm to a person.
PERSON = [
    "kill yourself", "kill urself", "hang yourself", "crawl back into your hole", "you disgust me", "you are nothing and you will always be nothing", "nobody wants you here", "you make us all sick",
    "should never have been born", "cleaner without you", "better off without you", "hit by a truck", "get hit by truck", "dies slowly", "hope you die", "go die", "drop dead",
    "sleep with one eye open", "coming for you", "find out where you live", "know where you live", "break every finger you have", "break your legs", "which school your sister goes", "waiting at your door with", "door with a bat",
    "line up whole team against wall", "line up against wall", "beat until no longer type", "somebody should beat", "smarter doorknobs than you", "they smelled better", "born this dumb", "parents drop you on head",
    "brain of a", "smells worse", "mother must be ashamed", "ashamed of having raised", "fuck yourself", "fuck you", "fuck off", "screw you", "shut your mouth", "shut your face", "shut the fuck up", "stfu u", "stfu you",
    "uglier than", "garbage like u", "garbage like you", "waste of oxygen", "waste of space", "piece of shit", "useless pathetic", "pathetic loser", "your face makes", "cut your throat", "wont walk out alive", "walk out of lab alive", "everyone in this thread knows it", "only like would keep such", "wer so ein bild ist ein", "auswahlt ist ein", "das weis hier jeder", "das weiss hier jeder", "tout le monde le sait", "todos lo saben", "slit your throat", "whoever picked is", "whoever wrote is", "are two who cant even", "are two piece of", "only piece of shit like", "would keep such a label", "i will kill you", "going to kill you", "i will hurt you",
    "verpiss dich", "dich will hier niemand", "bring dich endlich um", "bring dich doch um", "halt die fresse", "halts maul", "finde dich dann breche", "breche ich dir", "alle knochen", "du bist verdammter", "fick dich", "stirb endlich", "leck mich am arsch",
    "ferme ta gueule", "va te faire foutre", "va te faire enculer", "nique ta mere", "tu devrais te pendre", "personne ne te pleurera", "je sais ou tu habites", "vais te crever", "creve connard", "sale connard", "sale pute", "espece de", "tu nes quun sale",
    "callate la puta boca", "callate la boca", "pedazo de", "vete a la mierda", "ojala te mueras", "nadie te va a extranar", "se donde vives", "partir la cara", "eres un maldito", "hijo de puta", "te voy a matar", "matate", "que te jodan", "chinga tu madre",
]
#: Demeaning or wishing harm to a group.
GROUP = [
    f"people|folk|women|men|they|are {_VERMIN} and should be driven out", f"are {_VERMIN} should be driven out", "driven out of this country", f"steal and breed like {_VERMIN}", "they steal and breed", "breed like",
    f"away from our children they are {_VERMIN}", "away from our children", "ought to be locked up every last one", "locked up every last one", "must cleanse this", "cleanse this nation of", "before they outnumber us",
    "only good place for under the ground", "vanished from the map village", "no loss if vanished from map", "rope and a tall tree", "knew how to deal with rope tree", "being one of is an illness", "illness should be treated with fire",
    "their blood is dirty", "blood is dirty and so are their minds", "they are born liars", "born liars", "their kind is too", "too stupid to count to three", "why do we let label images their kind", f"women who are {_VERMIN}", "send them back to the kitchen", "back to kitchen where they belong",
    f"old people are {_VERMIN} let them rot", "vote on labels are let them rot", "let them rot", "anyone in a wheelchair like is a burden", "is a burden and should be put down", "should be put down", "go back to your country", "should be exterminated", "should be gassed",
    "sind ungeziefer und gehoren", "aus dem land gejagt", "sollte man wegsperren", "dieses pack stiehlt", "sind abschaum", "gehoren vergast", "dreckige auslander",
    "sont de la vermine", "faut les chasser dici", "se reproduisent comme des rats", "quon les enferme tous", "sale race",
    "son una plaga", "hay que echarlos del pais", "son ratas habria que encerrarlos", "habria que encerrarlos a todos", "hay que exterminarlos",
]
#: Sexually explicit matter.
SEXUAL = [
    "fuck her", "fuck him", "fuck me", "fucked her", "fucked him", "begged him to fuck", "pulled off her clothes and begged", "licked her until she came", "they undressed each other", "spank you", "until you drip", "cock in your mouth", "my cock", "his cock", "your cock", "on your knees with my",
    "your wet lips", "come over tonight and take it all off", "take it all off", "your bare ass", "bare ass", "sucked her nipples", "slid his hand between her legs", "she moaned while", "thighs trembled as he thrust", "he thrust deeper", "came all over her breasts", "all over her breasts", "came all over",
    "send me nudes", "i am so horny", "so horny", "hot naked singles", "with big tits", "big tits", "want to have sex with you", "sex with you tonight", "xxx videos", "hardcore fucking", "wet pussy", "and cum all night", "cum all night", "cheap escorts", "oral and anal", "blow job", "suck my dick", "suck my cock",
    "schick mir nacktbilder", "nacktbilder", "so geil auf dich", "geil auf dich", "er fickte sie", "sie fickte ihn", "fickte sie die ganze nacht",
    "photos de toi a poil", "toi a poil", "mexcites trop", "il la baisee", "la baisee toute la nuit", "elle la suce", "suce ma bite",
    "mandame fotos desnuda", "fotos desnuda", "estoy muy caliente", "se la follo", "follo toda la noche", "chupame la polla",
]
#: Insulting words, which count where they are addressed to someone or said of a person.
INSULTS = (
    "idiot idiots moron morons imbecile cretin fuckwit dipshit scumbag scum loser bastard asshole arsehole prick twat wanker dickhead motherfucker cunt bitch whore slut pig retard shithead douchebag clown parasite dumbass jackass fuckface bellend "
    "wichser arschloch vollidiot idiotin hurensohn missgeburt fotze schlampe drecksau schwachkopf dummkopf spast trottel penner scheisskerl "
    "connard connasse encule salope pute batard abruti cretin fdp enfoire ordure merdeux "
    "gilipollas cabron idiota imbecil pendejo puta zorra maricon capullo subnormal malparido hijoputa"
).split()
#: Words that address someone, or a remark about a person, beside an insult.
ADDRESS = (
    "you your u ur youre yourself thou what whoever du dich dir dein deine bist tu te toi ta ton espece tes nes eres tus pedazo ti total whoever sale such verdammter maldito useless pathetic worthless shitty stupid goddamn miserable"
).split()
#: Signs that words are only named: rules, lists, filters, other senses, praise, or said of oneself.
MENTIONS = [
    "rule forbids", "rules forbid", "forbids captions", "blocked terms", "blocked words", "query filter", "speech filters", "words like", "terms like", "invented example", "label means", "means a", "moderators removed", "removed an insulting", "spam folder", "none of them is repeated",
    "idiot proof", "dumb terminal", "im such an", "im such a", "i am such", "i forgot", "dont call each other names", "you absolute beast", "you killed it", "pipe fitting", "nursed her pups", "not anatomy", "worker process",
    "belong to", "verbietet worter", "worter wie", "in bildtexten", "gehort zur gruppe", "regle interdit", "mots comme", "dans les legendes", "sont ranges dans", "norma prohibe", "palabras como", "pies de foto", "polla de agua", "chatte dort", "hens stand", "two hens", "dead pixels", "master and slave",
]
#: Everyday words among the mentions: they take away single insults only, never a phrase.
WEAK = frozenset(["label means", "means a", "idiot proof", "im such an", "im such a", "i am such", "i forgot", "you absolute beast", "you killed it", "belong to", "worker process"])
#: "X is a ..." and what may stand between it and the insult; subjects that are no person or group.
PREDICATES = frozenset("is are was were ist sind war waren est sont es son".split())
FILLERS = frozenset("a an the such just all both really total complete absolute utter bunch of ein eine der die das alle un une des les una unos unas todos tous".split())
NO_PERSON = frozenset("it this that these those there here which what nobody noone none not es das dies ce cela eso esto i ich je yo".split())
#: Insults that are also animals, things or roles; as a predicate alone they say nothing.
SENSES = frozenset("clown parasite pig bitch scum loser cretin prick twat bastard retard penner spast ordure trottel zorra puta pute salope whore slut".split())
#: Written words of three and four letters that are words of their own, not a misspelled one.
COMMON = frozenset(
    "the and for you your are not but all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use that with have this will from they know want been good much some time "
    "very when come here just like long make many more only over such take than them well were what hand hard hold hole home hope full fill fall fell bill tell till mill hill sill cell call kiln tile bite site side wide hide ride sick rock lock back pack "
    "face fact race lace live line love rope ripe door poor moor wall walk talk tall rare card cord core cock deck duck luck fork work word dark rock tree free fire fine five four foot food feet team term tern text test then there hang rang bang long beat boat "
    "hare care dare fare mare ware base bore bars barn bark bake bale hate area cost host hens bees goat wolf bear seal lamb crab dove toad mole frog fish bird "
    "cut cat rat rot lot not got dot hot set shot shut show slow low row raw saw sat fit fix mix six sex sea set ass as his hit bit big bat bar car far war way"
    .split()
)

#: Words by the role they have in abuse; no role says anything alone.
ROLES = {
    "you": "you u ur youre du dich tu te vous ti",
    "object": "you yourself u",
    "clitic": "dich dir te toi vous matarte",
    "your": "your ur dir deine deinen tes ton tus",
    "they": "they them theyre people folk folks those women men sie diese pack ils elles eux ces ellos ellas estos son",
    "group": "immigrants migrants refugees foreigners muslims jews christians gays lesbians homosexuals transsexuals gypsies blacks arabs asians africans mexicans cripples auslander fluchtlinge juden schwule etrangers immigres juifs musulmans inmigrantes extranjeros judios moros gitanos",
    "intent": "will ill gonna going shall should ought must hope wish somebody someone sollte sollten soll werde muss gehoren hoffe devrais devrait devraient faut vais espere deberia deberian debe voy ojala hay habria",
    "threat": "matarte romperte degollarte",
    "deserve": "deserve deserves ought verdienst merites mereces",
    "harm": "kill hang strangle strangles drown drowns stab stabs shoot shoots murder murders lynch choke behead slaughter umbringen erschlagen erwurgen abstechen aufhangen pendre egorger etrangler tuer matar matarte degollar ahorcar estrangular",
    "hurt": "break cut slit smash crush snap rip breche brechen zerschlagen casser briser romper partir",
    "limb": "legs leg bones throat neck skull teeth fingers knochen beine genick hals zahne jambes gorge dents cou piernas cuello dientes",
    "vermin": "vermin scum filth trash subhuman subhumans cockroaches parasites plague maggots leeches lice savages ungeziefer abschaum parasiten vermine racaille cafards plaga escoria ratas cucarachas",
    "expel": "driven deported expelled exterminated gassed lynched eradicated sterilized sterilised locked caged shot hanged burned gejagt wegsperren vergast vertrieben ausgerottet chasser enferme enfermer expulser exterminer gazer echarlos expulsarlos encerrarlos exterminarlos",
    "act": "fuck fucked fucking fucks lick licked licking suck sucks sucked sucking fickte ficken leckte baiser baisee suce sucer follar chupar chupo",
    "flesh": "cock dick pussy tits boobs nipples breasts thighs ass schwanz titten muschi seins chatte bite polla tetas culo cono",
    "lust": "horny aroused geil excites cachonda cachondo",
}
#: What makes what: the word with the first role, and where from it (words before: negative) the other roles must stand.
RULES = [
    ("person", "harm", (("object", 1, 2), ("intent", -8, -1))),
    ("person", "harm", (("clitic", -3, 2), ("intent", -7, 7))),
    ("person", "harm", (("deserve", -3, -1), ("you", -6, -1))),
    ("person", "threat", (("intent", -5, 5),)),
    ("person", "hurt", (("limb", 1, 4), ("your", 1, 4), ("intent", -7, -1))),
    ("group", "vermin", (("they", -6, -1), ("expel", -9, 12))),
    ("group", "vermin", (("group", -6, -1), ("intent", -9, 9))),
    ("group", "expel", (("group", -8, 6), ("intent", -7, 7))),
    ("sexual", "act", (("flesh", 1, 3),)),
    ("sexual", "lust", (("you", 1, 4),)),
]
