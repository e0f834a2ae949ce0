"""Fixed values.

FIXED VALUES: the word lists, code-point ranges and regular expressions below
must equal the behaviour being reproduced for results to agree token for
token.  They are stated plainly, in their natural order, and nothing else in
the package restates them.  Larger tables (the HTML-4 named-entity map) are
built from the Python standard library instead of being written out.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES -- lexicons
# --------------------------------------------------------------------------

#: Emoticons, one per entry, whitespace separated (entries never contain blanks).
EMOTICONS = r"""
:@ :-@ >:o >:0 D:< D: D8 D; D= Dx >.< >_< d:< d: d8 d; d= dx v.v :/ :\ =/ =\ >:/ >:\
:-/ :-\ :) (: ;) ;( (; ); :-) :3 :d :D xd :') ^_^ ^.^ :] :} :p :b =p =b :-p :-b =) :(
): :'( :c :-( </3 :[ :{ T.T o_o O_O 0_o o_0 0_O O_0 o.o O.O 0.o o.0 :o :-o <3 :p :b =p
=b :-p :-b :$ XD xD
""".split()

#: English stop words used by the tokenizer-side filter and, by default, the job-side filter.
STOPWORDS_EN = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()

#: Tagalog stop words used by the job-side filter.
STOPWORDS_TL = """
akin aking ako alin am amin aming ang ano anumang apat at atin ating ay bababa bago bakit
bawat bilang dahil dalawa dapat din dito doon gagawin gayunman ginagawa ginawa ginawang
gumawa gusto habang hanggang hindi huwag iba ibaba ibabaw ibig ikaw ilagay ilalim ilan
inyong isa isang itaas ito iyo iyon iyong ka kahit kailangan kailanman kami kanila
kanilang kanino kanya kanyang kapag kapwa karamihan katiyakan katulad kaya kaysa ko kong
kulang kumuha kung laban lahat lamang likod lima maaari maaaring maging mahusay makita
marami marapat masyado may mayroon mga minsan mismo mula muli na nabanggit naging
nagkaroon nais nakita namin napaka narito nasaan ng ngayon ni nila nilang nito niya niyang
noon o pa paano pababa paggawa pagitan pagkakaroon pagkatapos palabas pamamagitan panahon
pangalawa para paraan pareho pataas pero pumunta pumupunta sa saan sabi sabihin sarili
sila sino siya tatlo tayo tulad tungkol una walang
""".split()

#: Top-level domains a bare host may end with to count as a URL (a tokenizer
#: parameter; this is its default value).
URL_DOMAINS = """
museum travel aero arpa asia coop info jobs mobi name post biz cat com edu gov int mil net
org pro tel xxx ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh
bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy
cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm
gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke
kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm
mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg
ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so
sr st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tp tr tt tv tw tz ua ug uk us uy uz
va vc ve vg vi vn vu wf ws ye yt za zm zw
""".split()

#: Emoji: single code points in these inclusive ranges.
EMOJI_RANGES = (
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6C5),
    (0x2600, 0x26FF),
    (0x1F170, 0x1F19A),
)

#: Spans that the optional quote filter removes (Python syntax).
QUOTED_RE = r"(“.*?”)|(\".*?\")|(‘.*?’)|(＂.*?＂)|\s('.*?')\s"

#: Quote characters; the splitter emits each as its own token.
QUOTE_CHARS = "“”\"‘’＂"

#: Characters the emoticon / punctuation splitter emits as their own token
#: (the quote characters above are appended to this set).
SPLIT_PUNCTUATION = "!$%()*+,-/:;<=>?[\\]^_.`{|}~'"

#: ASCII punctuation of the job-side filter (tokens that are a contiguous
#: piece of this string are dropped).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Replacement-token values that mean "drop the token".
DELETION_TOKENS = ("", "REMOVE", "remove", "DELETE", "delete")

#: Label used when a message has no label.
MISSING_LABEL = 2

# --------------------------------------------------------------------------
# FIXED VALUES -- token patterns (Python ``re`` syntax; the text module spells
# \w \d \s out as Python's Unicode classes when it compiles them for the JVM)
# --------------------------------------------------------------------------

USERNAME_RE = r"@\w{1,15}"
URL_RE_TEMPLATE = (
    r"(?:(?:https?\://[A-Za-z0-9\.]+)|(?:(?:www\.)?[A-Za-z0-9]+\.(?:{domains})))(?:\/\S+)?"
    r"(?=\s+|$)"
)
TIME_RE = r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?"
PHONE_RE = (
    r"(?:\+?[01][\-\s\.]*)?(?:\(?\d{3}[\-\s\.\)]*)?\d{3}[\-\s\.]*\d{4}(?:\s*x\s*\d+)?"
    r"(?=\s+|$)"
)
NUMBER_RE = r"(?:[+-]?\$?\d+(?:\.\d+)?(?:[eE]-?\d+)?%?)"
NUMBERS_RE = r"{0}(?:\s*/\s*{0})?".format(NUMBER_RE)
HASHTAG_SPLIT_RE = (
    r"[A-Z][a-z]+(?=[A-Z|\d|\w]?)|[A-Z]+(?=[A-Z][a-z]|\d|\s)|(?<=\d)+[nrt][dh]"
    r"|(?<=[#\s\d])[a-z]+(?=[A-Z]|\d|\w])|(?<=[\w]-)\w+"
)
WORD_RE = r"(?:[a-zA-Z]+)"
ELLIPSIS_RE = r"\.\.+"
OTHER_RE = r"(?:[^#\s\.]|\.(?!\.))+"
ENTITY_RE = r"&#?\w+;"
REPEATED_LETTER_RE = r"([a-zA-Z])\1\1+"
REPEATED_SYLLABLE_RE = r"([a-zA-Z][aeiouAEIOU]|[a-zA-Z][aeiouAEIOU][a-zA-Z]){1}\1\1+"

#: TF-IDF analyzer: lower-cased runs of two or more word characters.
TFIDF_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
#: Vocabulary size of the sparse branch.
TFIDF_MAX_FEATURES = 11024
