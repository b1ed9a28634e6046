"""Abusive, hateful and sexually explicit passages, by a weighted finite-state grammar.

A text is first written in plain letters: case, accents, look-alike letters, invisible signs, markup inside words,
figures for letters, stars, spaced and stretched words. Its clauses then pass through a composition of transducers
(:mod:`tidemark.llm.transducers`): phrases, targets (who is spoken to or of), insults and threats, and the clauses that
join these to a passage and give it a weight, beside machines for negation and reported speech. No word or phrase is a
case by itself: every rule that writes a weight joins it to a target, to another part of the same clause, or to the
place where a command stands. The score of a document is the greatest weight of any of its clauses, so long texts are
not at a disadvantage; from :data:`THRESHOLD` on it is a case. Every clause of a text is read, whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tokenizer import CHUNK
from tidemark.llm.transducers import Composition, Transducer, parse

THRESHOLD = 1.0

#: Letters of other scripts that pass for Latin ones.
LOOKALIKES = dict(
    zip("авекмнорстухіјѕԁһӏԛԝьαβεηικμνορτυχγωɡɩıøłđħŧß", "abekmhopctyxijsdhlqwbabenikuvoptuxywgiioldhts", strict=True)
)
#: Figures and signs that pass for letters.
FIGURES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l", "€": "e", "£": "l"}


def fold(text: str) -> str:
    """A text in plain lower-case letters; only for words of the lexicon, whole texts are folded by table."""
    out = []
    for c in text:
        d = unicodedata.normalize("NFKD", c)
        d = next((x for x in d if unicodedata.category(x) not in ("Mn", "Me", "Cf")), "")
        d = d.lower()[:1]
        d = unicodedata.normalize("NFKD", d)[:1] if d else d
        out.append(LOOKALIKES.get(d, d))
    return "".join(out)


# Lexicon: fixed values, one class a paragraph, in the languages of the corpus.
LEXICON = {
    # nouns that insult whoever they are said of
    "INS": """asshole arsehole bastard bastards bitch bitches moron morons idiot idiots imbecile imbeciles cretin cretins scumbag
        scumbags dickhead dickheads shithead shitheads shitbag halfwit halfwits dumbass dumbasses douchebag douche wanker wankers
        twat prick pricks fucker motherfucker cocksucker retard retards nitwit dimwit simpleton numbskull jackass dipshit bellend
        tosser twit twits coward cowards fool fools buffoon buffoons ignoramus creep creeps pervert perverts slut sluts whore whores skank faggot faggots nigger niggers kike kikes spic chink tranny cunts
        arschloch arschlocher drecksack drecksau wichser vollidiot schwachkopf hurensohn missgeburt trottel depp fotze schlampe
        dummkopf scheisskerl mistkerl bastarde idioten
        salaud salope connard connards connasse abruti cretins cretine encule batard pute fumier ordure debile imbeciles
        cabron imbecil malnacido gilipollas pendejo puta puto idiota hijoputa zorra mamon capullo estupido subnormal
        stronzo bastardo coglione puttana cretino deficiente filho-da-puta babaca otario
        идиот дебил кретин мудак сволочь урод ублюдок тварь придурок скотина сука гнида дурак мразь подонок пидор шлюха
        傻逼 白痴 混蛋 王八蛋 贱人 白癡 賤人 贱货 蠢货 蠢猪 笨蛋 废物 人渣 畜生 狗杂种 婊子 脑残 弱智 智障 傻瓜 操你妈""",
    # nouns that insult only in some uses
    "MAYBE": """arse pig pigs cow cows hag hags leeches maggot maggots cockroach cockroaches parasite parasites turd turds loser losers rat rats dog dogs swine vermin clown
        ape apes monkey monkeys scum trash garbage shit filth leech weasel snake worm failure dick cock cunt pussy ass zombie
        schwein schweine sau ratte affe hund ungeziefer cochon porc rat chien vermine cerdo perro rata свинья собака крыса козел""",
    "SCORN": """stupid useless worthless pathetic filthy miserable rotten lying brainless braindead bloody fucking damn damned dumb revolting
        disgusting ugly spineless gutless clueless cowardly arrogant ignorant repulsive vicious goddamn idiotic moronic fat dirty incompetent wretched sorry shitty bullshit crappy vile
        verdammter verdammte verdammtes elender elende hirnloser hirnlose damlicher damliche dummer dumme dreckiger blode bloder
        sale pauvre gros grosse stupide maldito maldita asqueroso estupida inutil тупой тупая тупые жалкий грязный вонючий""",
    "YOU": """you your yours yourself u ya du dich dir dein deine deinem deinen ihr euch tu toi te ton ta tes vous votre vos ti tus usted
        ustedes ты тебя тебе твой твоя вы вас вам 你 你们 您 妳 你們 你的 你们的""",
    "ROLE": """reviewer reviewers referee referees editor editors author authors supervisor advisor adviser committee chair boss professor
        whoever postdoc manager coauthor colleague student students lecturer dean
        gutachter gutachterin herausgeber autor autoren betreuer kollege professoren rapporteur relecteur editeur auteur
        revisor revisora editor autor supervisor рецензент редактор автор руководитель профессор 审稿人 评审 编辑 作者 导师 教授 主编""",
    "GROUP": """migrants migrant immigrants immigrant refugees refugee foreigners foreigner seekers gays gay lesbians homosexuals homosexual transgender
        disabled cripples women woman females girls natives native villagers peasants blacks whites jews jew muslims muslim christians
        hindus arabs asians africans mexicans gypsies roma blondes believers atheists feminists
        auslander fluchtlinge migranten frauen juden muslime schwule behinderte behinderten schwarze zigeuner turken
        refugies migrantes femmes juifs musulmans homosexuels handicapes etrangers noirs immigres arabes
        inmigrantes mujeres judios musulmanes extranjeros refugiados gitanos negros discapacitados maricones homosexuales
        беженцы приезжие мигранты евреи женщины мусульмане цыгане геи инвалиды иностранцы чурки 难民 移民 黑人 犹太人 穆斯林 同性恋 同性恋者 女人 残疾人 外国人 外地人 吉普赛人""",
    "THEY": "they them those theyre kind sort breed lot sie les ils elles ellos ellas los их они им 他们 她们 這些人 这些人",
    "COP": "etes is are was were be being am bist ist sind seid est sont es son eres sois to remain remains — – 是 就是 都是 真是",
    "LESS": """vermin filth filthy subhuman subhumans plague disease diseases parasites parasite animals beasts cattle primitive inferior
        cockroaches scum savages rats trash garbage pest pests cancer stink stinks smell stupid dumb terrorists evil liars inbred degenerate degenerates worthless
        thieves criminals rapists ungeziefer abschaum untermenschen dreck vermine racaille parasites ordures animaux betes
        plaga escoria basura animales ratas alimanas parasitos скот мусор твари животные звери недочеловеки паразиты 害虫 寄生虫 畜生 垃圾 人渣 蛆虫 劣等 低等 肮脏 祸害""",
    "OUST": """exterminated exterminate eradicated wiped wipe driven drive deported deport locked gassed hanged lynched stoned shot burned burnt
        beaten expelled castrated sterilised sterilized caged cage removed cleansed breed live exist eliminated slaughtered killed vote
        vertrieben ausgerottet vernichtet vergast abgeschoben jette expulse extermine eliminar expulsar echar exterminar fuera
        гнать выгнать уничтожить истребить депортировать 消灭 灭绝 赶走 驱逐 杀光""",
    "HARM": """die dies dead kill killed kills murder murdered shot shoot shooting drown drowned drowns drag dragged drags beat beaten rot
        rots choke chokes burn burns burned hang hanged stab stabbed slit strangle strangled rape raped smash smashed break breaks cut
        hurt bleed suffer torture tortured crush crushed punch punched bury buried run gut gutted skin suffocate jump
        sterben verrecken verrecke krepieren umbringen toten abstechen erschiessen creve crever mourir mourez tuer tuera egorger
        mueras murieras muere morir matar matare сдох сдохни сдохнет убью умри умрет убить сдохла 死 杀 杀死 杀了 打死 弄死 砍死 掐死 宰了 打断 强奸""",
    "PART": "knees knee legs children kids daughter son family wife mother house home throat neck face bones teeth head skull car fingers hands 腿 喉咙 孩子 全家 家人 脖子",
    "WISH": "hope wish may let ojala puisse чтоб чтобы hoffentlich 希望 愿 祝",
    "MUST": "should must ought shall deserve deserves belong belongs need needs gehoren gehort muss mussen soll sollen sollte doit doivent deberian deberia debe deben merecen надо должны нужно 应该 应当 必须 都该 该",
    "I": "i ill im ich je yo я we well wir nous 我 我们",
    "WILL": "will ill well gonna going werde werden vais voy 要 会 将",
    "ME": "me my mine him her his us mich mir sie ihn moi mon la le il elle él ella меня 我 他 她",
    "WHO": "he she i we postdoc manager wife husband student professor boss secretary nurse girl boy woman man er sie elle il ella el она он 他 她",
    "SEX": """fuck fucked fucks fucking screwed shagged banged blowjob handjob deepthroat cum cumming orgasm orgasmed ejaculated ficken fickte
        fickten gefickt baisa baiser baise baisait enculer follo follar folla follaba трахал трахнул трахает 操了 肏 干了 口交 做爱""",
    "TOUCH": """sucked sucks sucking suck licked licks licking lick rode rides ridden riding rubbed rubs rubbing rub stroked stroking spanked mounted
        fingered fondled groped grinding penetrated thrust lutschte leckte ritt rieb lecha suca chupo lamio""",
    "BODY": "cock cocks dick dicks pussy pussies cunt tits titties boobs nipples clit penis vagina boner balls schwanz muschi titten bite chatte nichons polla cono tetas хуй член пизда сиськи 鸡巴 骚逼 奶子 肉棒",
    "NAKED": "naked nude nue nackt nackte desnuda desnudo topless undressed stripped strip thighs thigh cuisses голая",
    "MOAN": "moaned moans moaning moan groaned panting haletante gimiendo stohnend stohnte stonhend begged climaxed climax came orgasm стонала",
    "OPEN": "spread spreads opened parted spreizte spreizt ecarta ecarte abrio abre раздвинула",
    "LEGS": "legs thighs beine cuisses jambes piernas ноги",
    "LURE": "horny porn porno uncensored xxx webcam camgirls escorts milf nudes hardcore sexcam hentai pornos geile porn 裸聊 约炮 援交 黄片 无码 激情视频 成人视频 色情",
    "HOT": "hot wet dripping hard sexy tits pussy cock dick pictures pics inside",
    "NOT": "not no never nobody without nicht kein keine nie ne pas jamais ningun nadie nunca не никогда don doesn isn aren wouldn 不 不是 没 没有 并非 别",
    # reported speech: words of studies and words of saying, and what leads from them to what is said
    "TOLD": """survey surveyed respondents respondent interviewed victims reported recruited studied cohort patients quoted quote slur slurs
        trials trial annotated annotators dataset linguistic enrolled clinics victim offender offenders perpetrator perpetrators witness witnesses plaintiff defendant complainant
        participants transcript transcripts tweets posts corpus coded testified""",
    "SAY": """say says said saying wrote write writes told tell tells called calls calling heard hear reported report reports quoted quote
        quotes threatened threatens stated answered replied described asked labelled labeled annotated tagged slur slurs insult insults phrase phrases""",
    "DET": "the a an this these those each every such any some der das ein eine el la una un le une",
    "WEAPON": "bullet bullets knife knives bomb axe rope noose kugel messer balle couteau bala cuchillo пулю нож",
    "LINK": "that whether as like such dass ob que si что",
    "ASKED": "surveyed respondents respondent interviewed recruited studied enrolled cohort",
    # words that patterns below name themselves
    "WORD": """screw stick shine sun cleaner steal lie trained ape roof bridge cliff ditch favour favor miss likes hell shut up fresse halt ferme
        gueule callate заткнись country think share office hire keep away find know where parks lives school reply birth bore
        born stinks stink breed read learn piece piss hatred hate rid off until table desk night kind asked wonder mierda merde scheisse
        maul klappe pathetic primitive world better throw comments""",
}
#: Phrases that count as one tag from their first word on.
PHRASES = {
    "HUSH": [
        "shut up", "shut your mouth", "shut your face", "screw you", "fuck you", "fuck off", "piss off", "go to hell", "burn in hell",
        "drop dead", "halt die fresse", "halt s maul", "halt das maul", "halt die klappe", "fick dich", "verpiss dich", "ferme ta gueule",
        "ta gueule", "va te faire", "nique ta", "vete a la mierda", "que te jodan", "chinga tu", "иди на", "пошел на", "пошел ты",
        "заткнись", "заткни пасть", "vaffanculo", "vai se foder", "kiss my ass", "eat shit", "go fuck", "滚开", "去死", "滚蛋", "滾開", "滾蛋", "闭嘴", "操你妈",
    ],
    "HUSHED": ["shut the fuck up", "shut the hell up", "get the fuck out", "get the hell out of my"],
    "QUIET": ["callate", "tais toi", "zitto"],
    "TURD": ["piece of shit", "pieces of shit", "sack of shit", "pile of shit", "son of a bitch", "sons of bitches", "bag of shit"],
    "WASTE": ["waste of oxygen", "waste of space", "stuck up"],
    "SUN": ["where the sun does not shine", "where the sun doesn t shine", "where the sun don t shine", "up your ass", "up your arse"],
    "UNMISSED": ["nobody would miss you", "no one would miss you", "nadie te echaria de menos", "niemand wurde dich vermissen", "personne ne te regretterait", "world would be better without you"],
    "SELF": ["kill yourself", "hang yourself", "shoot yourself", "drown yourself", "jump off the roof", "jump off a bridge", "jump off a cliff", "jump off the bridge", "end yourself", "bring dich um", "suicide toi", "убей себя"],
    "UNFIT": ["not deserve to live", "don t deserve to live", "not deserve to exist", "never breed", "not breed", "belong in a cage", "belong in cages", "belong in the gutter", "go back to where", "go back where", "gehoren vertrieben", "qu on les jette dehors", "jette dehors", "гнать их", "never have been born", "never been born", "should not exist", "not be allowed to live", "not be allowed to breed", "not be allowed to vote", "be put down", "being put down", "get put down", "put you down"],
    "BORN": ["born to steal", "born to lie", "breed like rats", "breed like rabbits", "stink and breed", "too primitive", "too stupid to", "too dumb to"],
    "FIND": ["find out where your", "find out where you", "know where you live", "know where you sleep", "know where your children", "know where your family"],
    "FEED": ["adults only", "18 only"],
}

#: Chinese words that hold a word of the lexicon and are none: Chinese has no blanks, so its runs are cut by longest match.
EVERYDAY_HAN = """一个 过去 失去 除去 死亡 死者 死锁 死区 死循环 死记 混蛋白 蛋白 寄生虫感染 寄生虫病 寄生虫学 害虫防治 垃圾分类 垃圾回收 垃圾邮件 编辑器 编辑距离 不会 会议
    社会 机会 学会 委员会 将来 即将 重要 主要 需要 要求 要素 摘要 必要 应该指出 是否 但是 于是 还是 可是 总是 个体 这样 真实 真空 真核 编辑部 杀虫 杀菌 杀伤 自杀""".split()

#: Targets: who is spoken to or of.
TARGETS = """
PERSON: YOU
PERSON: ROLE
THEM: GROUP
THEM: people|folks|persons|those <1 with|of <2 skin|race|faith|religion
THEM: black|brown|white|asian|african|arab|jewish|muslim|gay|disabled|foreign <0 people|folks|persons|men
THEYS: GROUP|skin|faith <9 THEY
"""
#: Insults and threats: what is said, whoever it is said to.
SAYINGS = """
SLUR: INS
SLUR: SCORN <1 MAYBE|INS
SLUR: TURD
SLUR: WASTE
DOOM: HARM
DOOM: UNFIT
DOOM: HARM <4 PART
"""
#: Passages: what makes a clause a case, with its weight. See :func:`tidemark.llm.transducers.parse` for the notation.
PASSAGES = """
2: YOU <2 COP <4 SLUR !
2: ROLE <7 COP <4 SLUR !
1.5: ROLE <3 INS !
1.6: YOU <1 SCORN <1 INS|MAYBE|TURD|WASTE
1.6: YOU <3^COP SCORN <1 INS|MAYBE
1.5: YOU|ROLE <4 COP <1 as|so|too|really|completely|utterly|plain|simply <0 stupid|dumb|brainless|braindead|pathetic|spineless|gutless|moronic|idiotic !
1.5: YOU <1 COP <0 stupid|dumb|brainless|braindead|pathetic|spineless|gutless|moronic|idiotic <0 END|,|and !
1.5: what <1 a <1 bunch|pack|gang <0 of <1 INS|MAYBE
1.5: bunch|pack|gang <0 of <1 INS|MAYBE <0 END|,
1.5: espece <0 de <1 INS|MAYBE
1.5: YOU <1^COP|NOT INS
1.5: you|u|ya|du|ihr|tu|vous|ты|вы|你|你们 <1 COP <2 LESS !
1.5: you|tu|du|vous|ты|вы <1 COP <2 shit|merde|scheisse|mierda|дерьмо|говно <0 END|, !
1.4: START <0 fuck|screw|damn <1 ROLE|GROUP
1.5: YOU <0 这个|这|个|这种|真|简直 <1 INS
1.5: START <0 COP <2 SLUR !
1.2: ROLE <7 COP <1 a|an <0 MAYBE !
1.2: ROLE|YOU <7 COP <1 a|an <1 MAYBE <0 END|, !
1.2: YOU <1 COP <1 a|an <0 MAYBE !
1.2: YOU <9 , <1 INS|MAYBE <0 ,|END
1.2: INS <0 , <9 YOU
1.2: START <0 INS <0 , <3 HARM
1.5: INS <0 写|写的
1.5: what|which <0 kind|sort <0 of <1 INS
1.5: START <0 what <0 a|an <1 SLUR
1.5: HUSH_FIRST <9^COP END
1.5: HUSH_FIRST <1 ,|INS|MAYBE|YOU
1.5: ,|and|or|so|just|please <0 HUSH <6^COP END|,
1.5: INS|SLUR <3^DET HUSH
1.5: you|tu|du|ты|你 <1 , <0 HUSH
1.5: HUSH <4^COP INS|MAYBE|ROLE|YOU
1.5: HUSHED_FIRST <9^COP END
1.5: HUSHED <1 ,|INS|MAYBE|YOU|ROLE
1.5: ROLE|YOU <2 can|should|may <0 HUSH
1.5: 你|你们|您 <0 HUSH
1.2: QUIET <3 INS|MAYBE
1.2: QUIET <3 UNMISSED
2: stick|shove|put|stuff|ram|push|take <8 SUN
1.5: ROLE|INS|MAYBE <12 SUN
1.5: reply <2 INS|MAYBE <2 :
1.5: only <1 INS|MAYBE <2 INS|MAYBE <2 would
1.3: only <1 INS|MAYBE <1 would
1.2: INS|MAYBE <0 or <1 INS|MAYBE <2 would
1.2: YOU|ROLE|INS|what|this|that|such <4 TURD
1.2: TURD <4 YOU|ROLE|who|would
1.2: YOU|ROLE <7 COP <4 WASTE !
1.2: YOU <1 WASTE
1.2: WASTE <1 INS|MAYBE|ROLE
1: SCORN <0 INS
1.2: trained <0 ape|monkey <8 not
1.2: even <2 ape|monkey|pig|dog|child <8 not
1.5: UNMISSED_FIRST <9 END|,
1.5: ,|and|but|because|since <0 UNMISSED
1.5: SELF_FIRST <9^COP END
1.5: SELF <0 YOU|INS|ROLE|,|END
1.5: SELF <4 INS|ROLE
1.5: MUST|please|just|and|or <1 SELF
1: nobody <0 likes <0 YOU
1.2: mother <2 have <0 HARM|aborted|swallowed <0 YOU
2: WISH <7 ROLE|YOU <5 HARM !
1.5: WISH <1 ROLE|YOU <0 HARM
1.5: WISH <2 ROLE|YOU|THEM <4 UNFIT
1.5: START <1^DET go|geh <0 HARM
2: ROLE|YOU <1 MUST <2 HARM *^DET !
2: ROLE <7 MUST <2 HARM|shot *^DET !
2: ROLE|YOU <7 MUST <3 UNFIT
2: MUST|WILL <1 HARM <3 ROLE|YOU <3 PART !
2: I <1 WILL <2 HARM <3 PART|ROLE|you|u|ya|dich|euch|te|vous|тебя|вас|你|你们 !
1.5: love|like|want|wants|wish <0 to <0 HARM <1 ROLE|you <0 END|,|and|for|with !
2: je|ich|yo|я <1 WILL <1 YOU <1 HARM !
2: je|ich|yo|я <1 YOU <2 HARM !
2: I <3 WILL <5 WEAPON <4 PART|YOU|ROLE
2: MUST|WILL <2 HARM <1 ROLE <0 END|,|and|who|before|if|tonight !
1.5: YOU|ROLE <0 WILL <1 die|rot|bleed|choke *^DET !
1.5: WEAPON <6 YOU <1 PART
2: I <1 WILL <1 FIND
1.5: I|we|they <3 know|find <2 where <1 YOU <1 PART
1.5: FIND <6 PART|school|work
1.5: I|we|they <4 FIND
1.5: FIND <1 END|,
1.5: I <0 know <0 where <6 parks|park|live|lives|sleep|sleeps
1.2: YOU|ROLE|INS|чтоб|чтобы <6 сдох|сдохни|сдохнет|verrecke|creve|mueras|murieras
1.2: START <1 сдохни|verrecke|creve
2: GROUP <4 COP <4 LESS !
2: THEM <2 COP <4 LESS !
1.6: GROUP <1^and|or|, LESS !
1.6: GROUP <1 — <1 LESS !
2: THEM <7 MUST <3 OUST !
2: THEM <5 UNFIT
2: no|kein|keine|aucun|ningun <0 THEM <1 MUST <2 be|exist|live|breed|vote <2 live|exist|breed|vote
2: THEM <7 BORN
2: THEYS <2 LESS !
2: THEYS <4 COP <3 LESS !
2: THEYS <2 BORN|UNFIT
1.6: THEYS|THEY <1 stink|breed <4 rats|rabbits|breed|animals
1.6: keep <3 THEM <4 away|out
1.6: never <1 hire|trust|employ|admit <3 THEM
1.6: NOT <1 share <4 THEM
1.6: cleaner|better|safer <0 without <3 THEM
1.6: get <0 rid <1 of <3 THEM
1.4: i|we <0 hate <3 THEM
1.5: kind|sort <1 COP <0 BORN
2: SEX <2 ME <12 moaned|came|climaxed|table|desk|bed
1.6: WHO <2 SEX <0 ME
1.6: I <1 want|wanna|love|like <1 to <0 SEX <0 YOU|ME
1.6: WHO <3 ME <0 SEX
1.6: SEX <0 ME <4 NAKED|BODY|LEGS
2: TOUCH <1 ME <12 came|climaxed|climax|orgasm
2: TOUCH <1 my|her|his <2 BODY
1.6: begged <3 TOUCH|SEX
1.6: begged <1 to <0 be <1 TOUCH|SEX
1.6: MOAN <10 NAKED|BODY|LEGS
1.6: NAKED <3 MOAN <6 LEGS
1.6: NAKED <9 OPEN <3 LEGS
2: OPEN <2 LEGS <12 BODY|SEX
1.6: stripped <8 BODY|LEGS
1.6: showed <0 me <3 BODY
1.6: came <0 in|on|inside|over <0 my|her|his <1 BODY|mouth|face
1.4: my|her|his|your <0 BODY <1 COP <1 wet|dripping|throbbing
1.3: my|her|his|your|that <1 hard|wet|dripping|tight|big|throbbing <0 BODY
1.4: LURE <9 LURE
1.4: LURE <6 BODY
1.3: hot <1 BODY <1 pictures|pics|videos|video
1.2: SEX <1 ME <9 mur|mesa|tisch|labortisch|стол
"""

_TOKEN = re.compile(r"[\w@$+!*€£|]+|[,;:—–\u0003\u0004]")
_SPACED = re.compile(r"(?<![\w@$+!*])[\w@$+!](?: [\w@$+!]){2,}(?![\w@$+!*])")
_END = re.compile(r"[.?!]+(?=[\s\\\"']|$)|\n\s*\n|[。！？]+")
#: Notes are clauses of their own, apart from the sentence that they hang on.
_NOTE = re.compile(r"\\(?:footnote|footnotetext|todo|marginpar)\*?\s*(?:\[[^\]]*\])?\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
_OPEN_NOTE = re.compile(r"\\(?:footnote|footnotetext|todo|marginpar)\*?\s*(?:\[[^\]]*\])?\{")
_QUOTED = re.compile(r"``.*?(?:''|$)|“.*?(?:[”“]|$)|„.*?(?:[”“]|$)|«.*?(?:»|$)|\"[^\"]*\"|`[^`']*'")
_SINGLE = re.compile(r" \S \S(?!\w)")
_MASK = re.compile(r"\w\*+\w")
_LONG = re.compile(r"(.)\1{2,}")


@lru_cache(1)
def grammar() -> tuple[dict, dict, Composition]:
    """(tags of each word of the lexicon, the same by first letter, length and last letter, the composed transducers)."""
    tags: dict[str, set[str]] = {}
    for tag, words in LEXICON.items():
        for w in words.split():
            tags.setdefault(fold(w), set()).add(tag)
    phrases = {tag: [fold(t).split() for t in texts] for tag, texts in PHRASES.items()}
    longest = {tag: max(map(len, found)) for tag, found in phrases.items()}
    texts = [f"{tag}{first}" + " <0 ".join(words) for tag, found in phrases.items() for words in found for first in (": ", "_FIRST: START <1^DET ")]
    lines = [texts, *(part.strip().split("\n") for part in (TARGETS, SAYINGS, PASSAGES))]
    layers = [Transducer([parse(line, fold, longest if n else {}) for line in part]) for n, part in enumerate(lines)]
    named = set().union(*(layer.words() for layer in layers))
    for w in named:
        tags.setdefault(w, set())
    lexicon = {w: frozenset(t | {w} if w in named else t) for w, t in tags.items()}
    masks: dict[tuple[str, int, str], set[str]] = {}
    for w, t in tags.items():
        if len(w) > 2 and t:
            masks.setdefault((w[0], len(w), w[-1]), set()).update(lexicon[w])
    return lexicon, masks, Composition(layers)


def plain_word(word: str, lexicon: dict, masks: dict) -> frozenset | None:
    """Tags of one word, whatever its disguise; None if it is no word of the lexicon."""
    if (t := lexicon.get(word)) is not None:
        return t
    if "*" in word and _MASK.search(word):
        w = word.strip("@$+!|")
        if (t := masks.get((w[0], len(w), w[-1]))) is not None:
            return frozenset(t)
        if w.count("*") > 2:
            return frozenset(("INS",))
    bare = word.strip("!|*+")
    if bare != word and (t := lexicon.get(bare)) is not None:
        return t
    forms = [word, bare]
    if any(c in FIGURES for c in word) and any(c.isalpha() for c in word):
        forms += ["".join(FIGURES.get(c, c) for c in x) for x in forms]
        forms += [x.replace("i", "l") for x in forms[2:]]
        if 0 < (ones := bare.count("1")) <= 4:
            for read in product("il", repeat=ones):
                one = iter(read)
                forms.append("".join(next(one) if c == "1" else FIGURES.get(c, c) for c in bare))
    for f in forms:
        for x in (f, _LONG.sub(r"\1", f), _LONG.sub(r"\1\1", f)):
            if x != word and len(x) > 2 and (t := lexicon.get(x)) is not None:
                return t
    return None


_GERMAN = frozenset("der das den dem des und ist nicht ihr ein eine einen einer von zu zur zum im sich wir ich mussen muss soll sollen sollte sollten werden wird haben hat gehoren hoffentlich autoren gutachter".split())
_THEIR = frozenset("your his her their yours".split())


def _everyday(words: list[str], tags: list[frozenset], at: int) -> bool:
    """Whether a word of harm with a common use of its own has that use: the German article die, to run a program, to cut
    a text. Whom it is done to tells: run you over, cut your throat."""
    after = words[at + 1 : at + 5]
    if words[at] == "die":
        return not _GERMAN.isdisjoint(words)
    if words[at] == "run":
        whom = after and (tags[at + 1] & {"YOU", "ME", "ROLE"} or after[0] == "them") and after[0] != "your"
        return not (("over" in after or "down" in after) and (whom or (at and words[at - 1] in ("be", "being", "get", "gets"))))
    if words[at] == "cut":
        near = bool(after) and after[0] in ("you", "him", "them", "yourself")
        return not (near or any(a in _THEIR and "PART" in b for a, b in zip(after, tags[at + 2 : at + 5], strict=False)))
    return False


#: Lines that are comments, as one: what they say begins with them.
_COMMENT = re.compile(r"\n[ \t]*%[^\n]*(?:\n[ \t]*%[^\n]*)*")
_COMMENT_SIGN = re.compile(r"\n[ \t]*%+[ \t]*")
_FONT = r"(?:bf|em|it|sl|sc|tt|rm|sf)\w*\s+"
#: What may part a word, by the sign that it begins with, which is all that a search looks for.
_PARTED = [
    ("{", re.compile(r"\{(?<=\w\{)\s*\}(?=\w)")),
    ("\\", re.compile(r"\\(?<=\w\\)(?:[/,!]|(?:allowbreak|kern0pt)(?: |\{\})?|-\s*)(?=\w)")),
    ('"', re.compile(r"\"(?<=\w\")[-|=](?=\w)")),
    ("-\n", re.compile(r"-\n(?<=\w-\n)[ \t]*%*[ \t]*(?=\w)")),
]
_SHAPED = [
    ("\\", re.compile(r"\\(?<=\w\\)(?:text\w+|emph|mbox|underline|uline|hbox|sout|so|uppercase|lowercase)\{"), ""),
    ("\\", re.compile(r"\\[a-z]+(?:(?=\\)|\*?(?:\[[^\]]*\])?\{)"), " "),
    ("{\\", re.compile(r"\{\\(?<=\w\{\\)" + _FONT + r"(?=\w)"), ""),
    ("}", re.compile(r"\}(?<=\w\})(?=\w)"), ""),
]


def _rejoin(text: str) -> str:
    """A text without the markup and line ends that part words."""
    for sign, pattern in _PARTED:
        if sign in text:
            text = pattern.sub("", text)
    if "%" in text:
        text = _COMMENT.sub(lambda m: "\n\u0003 " + _COMMENT_SIGN.sub("\n ", m.group()), "\n" + text)
    for sign, pattern, by in _SHAPED:
        if sign in text:
            text = pattern.sub(by, text)
    return text


_HAN = re.compile(r"[\u3400-\u9fff]+")


@lru_cache(1)
def _han_words() -> re.Pattern:
    words = {w for w in grammar()[0] if _HAN.fullmatch(w)} | set(EVERYDAY_HAN)
    return re.compile("|".join(sorted(words, key=lambda w: (-len(w), w))) + "|(?:.(?=.)(?!" + "|".join(sorted(words)) + ")).|.")


def _cut_han(text: str) -> str:
    """A text with its Chinese runs cut into words: those of the lexicon by longest match, the rest in pieces of one or two."""

    def words(m: re.Match) -> str:
        before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
        return "\u0002" * bool(_TOKEN.match(before)) + "\u0002".join(_han_words().findall(m.group())) + "\u0002" * bool(_TOKEN.match(after))

    return text if text.isascii() else _HAN.sub(words, text)


class _Words(dict):
    """The symbol of each word as it stands in a text; 0 is a word without a part in any rule."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        lexicon, masks, machine = grammar()
        tags = _SIGNS.get(word) or plain_word(word, lexicon, masks)
        self[word] = machine.symbol(tags or frozenset())
        return self[word]


_SIGNS = {"\u0004": frozenset(("CUT",)), ",": frozenset(","), **{c: frozenset((c, "START")) for c in ":—–"}, **{c: frozenset((c, "START", "END")) for c in ";\u0003"}}
_OFTEN_HARMLESS = ("die", "run", "cut")


@lru_cache(1)
def _reader() -> tuple[_Words, int, int, frozenset, int]:
    """(symbols of words, of the begin of a clause, of its end, of words with a common use, of what parts clauses)."""
    machine = grammar()[2]
    machine.symbol(frozenset())
    words = _Words()
    often = frozenset(words[w] for w in _OFTEN_HARMLESS)
    return words, machine.symbol(frozenset(("START",))), machine.symbol(frozenset(("END",))), often, words["\u0004"]


def _joined(m: re.Match) -> str:
    """Single letters with blanks between them that are a word of the lexicon."""
    lexicon, masks, _ = grammar()
    letters = m.group().replace(" ", "")
    for x in (letters, letters[1:], letters[:-1]):
        if plain_word(x, lexicon, masks) is not None:
            before = letters[0] + " " if x == letters[1:] and x != letters else ""
            return f"{before}{x}" + (" " + letters[-1] if x == letters[:-1] and x != letters else "")
    return m.group()


def prepared(text: str) -> str:
    """A folded text in plain words, its clauses parted by U+0004. Notes are clauses apart from the sentence that they hang
    on."""
    notes: list[str] = []
    if "\\" in text:
        while (rest := _NOTE.sub(lambda m: notes.append(m[1]) or " ", text)) != text:
            text = rest
        for i in range(len(notes)):  # a note within a note
            while (rest := _NOTE.sub(lambda m: notes.append(m[1]) or " ", notes[i])) != notes[i]:
                notes[i] = rest
        text = _OPEN_NOTE.sub("\n\n", "\n\n".join([text, *notes]))
    text = _COMMAND.sub(" ", _cut_han(_rejoin(text)))
    return " ".join(_END.sub("\u0004", text).split())


def clauses(text: str) -> Iterator[str]:
    """The clauses of a prepared text that hold a word without which no rule is met. All that is left out has no weight."""
    symbols = list(map(_reader()[0].__getitem__, _TOKEN.findall(text)))
    found = np.array(symbols, np.int32)
    cut = found == _reader()[4]
    held = set(np.cumsum(cut)[_pivotal()[found]].tolist())
    parts = text.split("\u0004")
    if _SINGLE.search(text):  # single letters may be a word
        held |= {i for i, part in enumerate(parts) if _SINGLE.search(part)}
    for i in sorted(held):
        part = parts[i].strip()
        yield _SPACED.sub(_joined, part) if _SINGLE.search(part) else part


#: Names of tags and words that are met often; they only choose which word of a rule is looked for first.
_COMMON = frozenset("YOU ROLE COP THEY NOT MUST WISH I WILL ME WHO TOLD SAY LINK ASKED HOT PART OPEN LEGS DET START END PERSON GROUP THEM THEYS".split()) | frozenset(
    "of to the a an be is not would only or and in on for with that this what who no than never have where so as i you we keep get better put down out out way away your where off kind sort even long live exist without , : ; —".split()
)
_PIVOTAL: dict[int, np.ndarray] = {}


@lru_cache(1)
def _pivots() -> frozenset:
    return grammar()[2].pivots(_COMMON)


def _pivotal() -> np.ndarray:
    """Whether each symbol has a tag without one of which no rule is met."""
    machine = grammar()[2]
    n = len(machine.symbols)
    if n not in _PIVOTAL:
        pivots = _pivots()
        _PIVOTAL.clear()
        _PIVOTAL[n] = np.array([bool(t & pivots) for t in machine.symbols], bool)
    return _PIVOTAL[n]


_COMMAND = re.compile(r"[\\{}~%](?:(?<=\\)[a-z]+)?")
_QUOTE_SIGNS = frozenset("\"`“„«")


def clause_score(clause: str) -> float:
    """The greatest weight of a passage in a clause."""
    machine = grammar()[2]
    words, begin, end, often, _ = _reader()
    found = _TOKEN.findall(clause)
    symbols = list(map(words.__getitem__, found))
    if not any(symbols):
        return 0.0
    tags = None
    if not _QUOTE_SIGNS.isdisjoint(clause):
        quotes = [m.span() for m in _QUOTED.finditer(clause)]
        inside = [any(a < m.start() < b for a, b in quotes) for m in _TOKEN.finditer(clause)]
        tags = [machine.symbols[s] for s in symbols]
        told = any("TOLD" in t for t in tags) and any(not q and t & {"TOLD", "SAY"} for q, t in zip(inside, tags, strict=True))
        if told:
            tags = [t | {"REPORTED"} if q else t for q, t in zip(inside, tags, strict=True)]
    if not often.isdisjoint(symbols):
        tags = tags or [machine.symbols[s] for s in symbols]
        tags = [t - {"HARM"} if "HARM" in t and _everyday(found, tags, i) else t for i, t in enumerate(tags)]
    if tags:
        symbols = [machine.symbol(t) for t in tags]
    return machine.score([begin, *symbols, end])


@lru_cache(1)
def folding() -> np.ndarray:
    """The folded code point of each, 0 for those that are left out."""
    n = 0x110000
    folded = np.arange(n, dtype=np.uint32)
    for i in range(n):
        if 0xD800 <= i < 0xE000 or 0xE000 <= i < 0xF900 or 0xAC00 <= i < 0xD7A4 or 0x3400 <= i < 0xA000 or i >= 0x20000:
            if i >= 0xE0000:
                folded[i] = 0
            continue
        f = fold(chr(i))
        folded[i] = ord(f) if f else 0
    return folded


_SOFT_HYPHEN = re.compile(r"\\-(?![ \t\r\n])")


def folded(text: str) -> str:
    """A text in plain lower-case letters."""
    if text.isascii():
        return _SOFT_HYPHEN.sub("", text.lower())
    points = folding()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    plain = points[points != 0].tobytes().decode("utf-32-le")
    return _SOFT_HYPHEN.sub("", plain)


def parts(text: str) -> Iterator[str]:
    """A text in parts of about a chunk, which end where a clause does."""
    at = 0
    while len(text) - at > CHUNK:
        ends = [e for mark in ("\n\n", "。", "! ", "? ") if (e := text.find(mark, at + CHUNK)) >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


def scores(texts: list[str]) -> np.ndarray:
    """Score of each text."""
    return np.array([max((clause_score(c) for part in parts(t) for c in clauses(prepared(folded(part)))), default=0.0) for t in texts])


def score_documents(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the score of each whole text; null and empty texts score 0."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = scores([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.float64())], [*keep, "score"])

    return df.select(*keep, text).mapInArrow(run, f"{schema}, score double")
