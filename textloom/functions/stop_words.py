"""Stop words by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words that carry no meaning of their own, in English prose and in Java sources.
ENGLISH = """
i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom whose this that these those am is are was were
be been being have has had having do does did doing will would should can could ought i'm you're he's she's it's
we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll
isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot
couldn't mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if or because
as until while of at by for with about against between into through during before after above below to from up upon
down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very say says said shall atr
"""
JAVA = """
abstract assert boolean break byte case catch char class const continue default do double else enum extends false
final finally float for goto if implements import instanceof int interface long native new null package private
protected public return short static strictfp super switch synchronized this throw throws transient true try void
volatile while foo java javadoc applet awt dnd geom im ref nio dgc acl chrono jar regex util zip bmp jpeg io jws
soap bean openmbean ldap net rmi ssl auth kerberos x500 sasl midi spi sql serial plaf basic metal multi nimbus synth
html rtf swing undo tools xa helpers dsig spec namespace stax handler http ws xpath ietf jgss Corba IOP stub
bootstrap omg w3c dom org lang ls xml sax ext javax javadocs javascript javatuples
"""
LANGUAGES = {"english": ENGLISH, "java": JAVA}


def stop_list(*languages: str) -> list[str]:
    """Distinct lower-cased words of the languages (default: all), in order."""
    return list(dict.fromkeys(w.lower() for name in languages or LANGUAGES for w in LANGUAGES[name].split()))


def stop_words(spark: SparkSession, *languages: str) -> DataFrame:
    """lang, word: the lists as a table."""
    return spark.createDataFrame([(name, w) for name in languages or LANGUAGES for w in stop_list(name)], "lang string, word string")


def read_stop_words(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, word of a text file: what follows | in a line is a comment, words stand between white space, case is ignored."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\\|.*", "").alias("line"))
    words = lines.select(F.explode(F.split(F.trim("line"), "\\s+")).alias("word")).where("word <> ''")
    return words.select(F.lit(lang).alias("lang"), F.lower("word").alias("word")).distinct()


def is_stop_word(word: Column, *languages: str) -> Column:
    """A word of one letter is a stop word; any other is looked up in lower case, with a plain apostrophe."""
    plain = F.lower(F.replace(word, F.lit("\u2019"), F.lit("'")))
    return (F.length(word) == 1) | plain.isin(stop_list(*languages))


def in_any_list(word: Column, languages: list[str]) -> Column:
    """Is the word a stop word of any of the languages? Of no language, no word is, not even one of one letter."""
    return is_stop_word(word, *languages) if languages else F.lit(False)
