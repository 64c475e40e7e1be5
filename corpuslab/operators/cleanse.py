"""Text cleansing and dictionary lemmatisation (rows 7, 20-23, 26, 43-44, 50, 58, 60, 77-87).

Words are found by numpy over whole text columns (:mod:`corpuslab.operators.words`), not by a pattern a token. Both texts of the
documents are made in blocks of some MB of text: only a block's *distinct* words meet the lexicon, so what is joined and
shuffled are dictionaries, not tokens, and a frequent word has at most one row a block. Rows of tokens join a broadcast lexicon;
those that meet a lexicon too large for that come from the blocks too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.lists import ENTITY_EXCLUSIONS
from corpuslab.operators import words as wd
from corpuslab.sources.tables import stage_roundtrip

MAX_BROADCAST_LEXICON_ROWS = 1_000_000  # two short strings a row: some tens of MB
HOT_SHARE = 4  # a word that fills a quarter of an average shuffle partition is hot


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_LEXICON_ROWS) -> DataFrame:
    """Broadcast hint only when the row count is within ``max_rows``; otherwise a shuffle join.

    Call it on a materialised table (a file or a checkpoint): the count is then cheap.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def project_text(df: DataFrame, id_col: str = "my_id", text_col: str = "text") -> DataFrame:
    """``table[, c("my_id","text")]`` (row 7)."""
    return df.select(id_col, text_col)


def tokenise(df: DataFrame, id_col: str = "my_id", text_col: str = "text") -> DataFrame:
    """White-space normalisation, split on single spaces, one row per token (rows 50, 77, 78).

    ``order`` is the 1-based position among the non-empty pieces, as a split
    that drops empty pieces numbers them.
    """
    pieces = F.filter(F.split(tx.normalise_ws(text_col), " "), lambda x: x != F.lit(""))
    return df.select(F.col(id_col), F.posexplode(pieces).alias("pos", "token")).select(
        id_col, (F.col("pos") + F.lit(1)).cast("int").alias("order"), "token"
    )


def add_words(tokens: DataFrame, codepoints_first: bool = False) -> DataFrame:
    """Token -> ``word``: URL, e-mail and non-letters removed, lower case (rows 79-83)."""
    return tokens.withColumn("word", tx.clean_word("token", codepoints_first))


def drop_short(df: DataFrame, col: str = "word", min_len: int = 3) -> DataFrame:
    """Keep rows whose ``col`` has more than ``min_len`` characters; null drops out (rows 84, 85)."""
    return df.where(F.length(col) > min_len)


def word_table(scoped: DataFrame, id_col: str = "my_id", min_len: int = 3, codepoints_first: bool = False, tokens: bool = True) -> DataFrame:
    """Scoped articles -> ``(my_id, order, token, word)`` with words longer than ``min_len``; ``token`` only on demand.

    :func:`tokenise`, :func:`add_words` and :func:`drop_short` in one pass over the text column (with ``codepoints_first`` the three themselves).
    """
    if codepoints_first:
        rows = drop_short(add_words(tokenise(scoped, id_col), codepoints_first), "word", min_len)
        return rows if tokens else rows.drop("token")
    texts = _texts(scoped, id_col)
    return texts.mapInArrow(wd.word_rows(min_len, tokens, id_col), f"{_id_field(texts)}, order int, {'token string, ' if tokens else ''}word string")


def _texts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))


def _id_field(df: DataFrame) -> str:
    return f"`{df.columns[0]}` {df.schema[0].dataType.simpleString()}"


def word_counts(scoped: DataFrame, min_len: int = 3) -> DataFrame:
    """``(word, n)`` of the words of :func:`word_table`, counted inside the tasks: a word has a row for each slice of texts it occurs in."""
    return scoped.select(F.col("text").cast("string").alias("text")).mapInArrow(wd.word_counts(min_len), "word string, n long")


def word_blocks(scoped: DataFrame, id_col: str = "my_id", min_len: int = 3, tokens: bool = False) -> DataFrame:
    """The words of :func:`word_table` in blocks of documents, coded by each block's distinct words. Written, as a block's number is a task's."""
    texts = _texts(scoped, id_col)
    ids = f"ids array<{texts.schema[0].dataType.simpleString()}>"
    return stage_roundtrip(texts.mapInArrow(wd.word_blocks(min_len, tokens), f"block long, {ids}, {wd.BLOCK_FIELDS}"), "word-blocks")


def lemmatise_blocks(blocks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``blocks`` with ``lemmas``: the (code, lemma) of every lexicon row of its words, ordered. The join of :func:`lemmatise` on each block's distinct words."""
    words = blocks.select("block", F.posexplode("vocab").alias("code", "word"))
    met = words.join(lexicon.select("word", "lemma"), "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "lemma"))).alias("lemmas"))
    return blocks.join(met, "block", "left")


def hot_words(words: DataFrame) -> DataFrame:
    """``(word, n)`` of the words that alone would fill ``1 / HOT_SHARE`` of an average shuffle partition, found by one partial count. Written.

    There are at most ``HOT_SHARE`` times the number of shuffle partitions of them, whatever the data.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage_roundtrip(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") * F.lit(HOT_SHARE * parts) >= F.col("_all"))
    return stage_roundtrip(hot.select("word", "n"), "hot-words")


def lemmatise(words: DataFrame, lexicon: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Left join on ``word``; a word with two lemmas fans out (rows 20, 21).

    With ``hot`` (:func:`hot_words`, for a lexicon too large to broadcast) the hot words meet their own lexicon rows by a
    broadcast behind a count, and only the other words are shuffled, so no task gets much more than the others.
    """
    lexicon = lexicon.select("word", "lemma")
    if hot is None:
        return words.join(lexicon, "word", "left")
    names = F.broadcast(hot.select("word"))
    known = stage_roundtrip(lexicon.join(names, "word", "left_semi"), "hot-lemmas")
    often = words.join(names, "word", "left_semi").join(checked_broadcast(known), "word", "left")
    seldom = words.join(names, "word", "left_anti").join(lexicon, "word", "left")
    return often.unionByName(seldom)


def oov_words(joined: DataFrame) -> DataFrame:
    """Tokens whose lemma is null after the join (rows 14, 26)."""
    return joined.where(F.col("lemma").isNull())


def oov_top_words(words: DataFrame, lexicon: DataFrame, top_n: int = 600, exclude_entities: bool = False, large: bool = False) -> DataFrame:
    """The ``top_n`` most frequent out-of-vocabulary words (count desc, word asc) (rows 55, 86).

    Anti join against the lexicon words that carry a lemma, partial count per
    word (of rows, or of ``n`` where ``words`` are counts already), then a distributed top-k: nothing is collected. Against a ``large`` lexicon the words are counted first, so each is shuffled once.
    """
    known = lexicon.where(F.col("lemma").isNotNull()).select("word").distinct()
    counts = words if large else words.join(known, "word", "left_anti")
    counts = counts.groupBy("word").agg((F.sum("n") if "n" in words.columns else F.count(F.lit(1))).alias("n"))
    if large:
        counts = counts.join(known, "word", "left_anti")
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(top_n)
    if exclude_entities:
        top = lexicon_exclusions(top)
    return top


def token_audit(counts: DataFrame, lexicon: DataFrame, top_n: int = 600, min_len: int = 3) -> DataFrame:
    """Rows and distinct words after each cleansing step, ``(stage, n_rows, n_unique)`` (row 6).

    ``counts`` is ``(word, n)`` over all tokens: every step's figures follow from the
    counts per word, so the texts are read once.
    """
    words = drop_short(counts, "word", min_len)
    top = words.join(lexicon.where(F.col("lemma").isNotNull()).select("word"), "word", "left_anti").orderBy(F.desc("n"), F.asc("word")).limit(top_n)

    def card(df, stage):
        return df.agg(
            F.lit(stage).alias("stage"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
            F.countDistinct("word").alias("n_unique"),
        )

    def lemmatised(lex):
        return drop_short(words.join(lex, "word"), "lemma", min_len)

    first = lemmatised(lexicon.select("word", "lemma"))
    grown = first.unionByName(lemmatised(top.select("word", F.col("word").alias("lemma"))))
    return card(counts, "tokens").unionByName(card(words, "words")).unionByName(card(first, "lemmatised")).unionByName(card(grown, "lemmatised_grown"))


def lexicon_exclusions(words: DataFrame, col: str = "word", exclusions=ENTITY_EXCLUSIONS) -> DataFrame:
    """Drop the hand-made entity list from the growth words (row 60)."""
    return words.where(~F.col(col).isin(*exclusions))


def extend_lexicon(lexicon: DataFrame, new_words: DataFrame) -> DataFrame:
    """Union all: each added word is its own lemma (row 58)."""
    return lexicon.select("word", "lemma").unionByName(
        new_words.select(F.col("word"), F.col("word").alias("lemma"))
    )


def augment_lexicon(lexicon: DataFrame, words: DataFrame, top_n: int = 600, exclude_entities: bool = False, written: bool = False) -> DataFrame:
    """Lexicon grown by the most frequent unmatched words (row 86). ``written``: these are, so every use of the lexicon finds them counted."""
    large = lexicon.count() > MAX_BROADCAST_LEXICON_ROWS
    top = oov_top_words(words, lexicon, top_n, exclude_entities, large)
    grown = extend_lexicon(lexicon, stage_roundtrip(top, "growth-words") if written else top)
    # a hint inside a union is lost, so the whole is hinted: a counted lexicon and at most top_n rows
    return grown if large else F.broadcast(grown)


def _ordered_join(values) -> F.Column:
    return F.concat_ws(" ", F.transform(F.sort_array(values), lambda s: s["v"]))


def collapse_texts(joined: DataFrame, id_col: str = "my_id", min_lemma_len: int = 3) -> DataFrame:
    """Per document: words and (long enough) lemmas, each joined by spaces in token order (rows 22, 43, 44).

    One aggregation produces both texts, so the script's join of the two
    per-document tables (row 22) needs no extra shuffle. A document without
    any kept lemma gets a null ``lemma_text``, as the left join gives in the script.
    One list is shuffled for both: an entry has its place once, and the lemma only where it differs from the word (``k``: 0 none, 1 the word, 2 ``l``).
    """
    lem_ok = F.coalesce(F.length("lemma") > min_lemma_len, F.lit(False))
    same = lem_ok & F.col("lemma").eqNullSafe(F.col("word"))
    kind = F.when(same, 1).when(lem_ok, 2).otherwise(0).cast("byte")
    entry = F.struct(F.col("order").alias("o"), F.col("word").alias("v"), kind.alias("k"), F.when(lem_ok & ~same, F.col("lemma")).alias("l"))
    g = joined.groupBy(id_col).agg(F.collect_list(entry).alias("_e"))
    lemma = F.transform(F.filter("_e", lambda x: x["k"] > 0), lambda x: F.struct(x["o"].alias("o"), F.coalesce(x["l"], x["v"]).alias("v")))
    words = F.transform("_e", lambda x: F.struct(x["o"].alias("o"), x["v"].alias("v")))
    g = g.select(id_col, words.alias("_w"), lemma.alias("_l"))
    return g.select(
        id_col,
        _ordered_join(F.col("_w")).alias("clean_word_text"),
        F.when(F.size("_l") > 0, _ordered_join(F.col("_l"))).alias("lemma_text"),
    )


def ordered_text(df: DataFrame, id_col: str, order_col: str, value_col: str, out_col: str) -> DataFrame:
    """``ddply(.., summarise, paste0(value, collapse=" "))`` after sorting by id and order (rows 43, 44)."""
    v = F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v")))
    return df.groupBy(id_col).agg(_ordered_join(v).alias(out_col))


class Chain:
    """The cleansing chain over scoped articles and a lexicon (row 87): tokens -> words -> lexicon join -> growth -> re-join -> texts.

    ``lexicon`` should be materialised (file or checkpoint). Rows of tokens join it by broadcast behind a row-count check;
    beyond that, and for the texts, :func:`word_blocks` are written and only their distinct words join it.
    """

    def __init__(self, scoped: DataFrame, lexicon: DataFrame, top_n: int = 600, id_col: str = "my_id", exclude_entities: bool = False):
        self.scoped, self.top_n, self.id_col, self.exclude_entities = scoped, top_n, id_col, exclude_entities
        self.words = word_table(scoped, id_col)
        self.large = lexicon.count() > MAX_BROADCAST_LEXICON_ROWS
        self.lexicon = lexicon if self.large else F.broadcast(lexicon)
        self._hot: DataFrame | None = None
        self._blocks: dict[bool, DataFrame] = {}
        self._grown: DataFrame | None = None

    @property
    def hot(self) -> DataFrame | None:
        if self.large and self._hot is None:
            self._hot = hot_words(self.words)
        return self._hot

    def blocks(self, tokens: bool = False) -> DataFrame:
        if True in self._blocks or tokens in self._blocks:
            return self._blocks.get(tokens, self._blocks.get(True))
        self._blocks[tokens] = word_blocks(self.scoped, self.id_col, tokens=tokens)
        return self._blocks[tokens]

    def counts(self) -> DataFrame:
        """``(word, n)`` for the growth: of the blocks where they are written, else of the texts."""
        if not self._blocks:
            return word_counts(self.scoped)
        return self.blocks().select(F.explode(F.arrays_zip("vocab", "counts")).alias("_w")).select(F.col("_w.vocab").alias("word"), F.col("_w.counts").alias("n"))

    def _rows(self, lexicon, tokens: bool) -> DataFrame:
        if not self.large:
            return lemmatise(word_table(self.scoped, self.id_col, tokens=tokens), lexicon())
        blocks = self.blocks(tokens)  # before the lexicon grows: the growth reads their counts
        ids = blocks.schema["ids"].dataType.elementType.simpleString()
        return lemmatise_blocks(blocks, lexicon()).mapInArrow(
            wd.block_rows(tokens, self.id_col), f"word string, `{self.id_col}` {ids}, order int, {'token string, ' if tokens else ''}lemma string")

    def joined(self, tokens: bool = False) -> DataFrame:
        return self._rows(lambda: self.lexicon, tokens)

    def growth(self) -> DataFrame:
        return oov_top_words(self.counts(), self.lexicon, self.top_n, self.exclude_entities, self.large)

    def grown_lexicon(self) -> DataFrame:
        return augment_lexicon(self.lexicon, self.counts(), self.top_n, self.exclude_entities) if self._grown is None else self._grown

    def write_growth(self) -> None:
        """The growth is counted now, from the blocks, and once: for a run that uses the grown lexicon several times."""
        self.blocks()
        self._grown = augment_lexicon(self.lexicon, self.counts(), self.top_n, self.exclude_entities, written=True)

    def rejoined(self, tokens: bool = False) -> DataFrame:
        return self._rows(self.grown_lexicon, tokens)

    def texts(self) -> DataFrame:
        """``(id, clean_word_text, lemma_text)`` of :func:`collapse_texts`, without a shuffle of tokens. Ids of several rows, whose words
        belong to one text, are collapsed by it themselves."""
        blocks = self.blocks()
        ids = blocks.schema["ids"].dataType.elementType.simpleString()
        met = lemmatise_blocks(blocks, self.grown_lexicon())
        once = met.mapInArrow(wd.block_texts(3, self.id_col), f"`{self.id_col}` {ids}, clean_word_text string, lemma_text string")
        again = blocks.select(F.explode("ids").alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
        if again.isEmpty():
            return once
        again = stage_roundtrip(again, "ids-of-several-rows")
        same = F.col(self.id_col).eqNullSafe(F.col("_id"))
        return once.join(again, same, "left_anti").unionByName(collapse_texts(self.rejoined().join(again, same, "left_semi"), self.id_col))


def clean_corpus(scoped: DataFrame, lexicon: DataFrame, top_n: int = 600, id_col: str = "my_id",
                 exclude_entities: bool = False, attach: bool = False) -> DataFrame:
    """Both texts of every document that keeps a word, through :class:`Chain`; with ``attach`` as columns of ``scoped``."""
    texts = Chain(scoped, lexicon, top_n, id_col, exclude_entities).texts()
    return scoped.join(texts, id_col, "left") if attach else texts


def fixture_words(articles: DataFrame) -> DataFrame:
    """``(doc_id, word)`` from every article: dateline strip, split on spaces, URL / e-mail /
    letters-only cleaning, words longer than 3 (FIXTURES.md section 3)."""
    return word_table(_stripped(articles), "doc_id", tokens=False).select("doc_id", "word")


def _stripped(articles: DataFrame) -> DataFrame:
    return articles.select("doc_id", tx.dateline_strip("text").alias("text"))


def fixture_lexicon(articles: DataFrame) -> DataFrame:
    """Stand-in lexicon derived from the corpus (FIXTURES.md section 3): words whose length is
    not a multiple of 3 get a suffix-cut lemma."""
    words = word_counts(_stripped(articles)).select("word")
    return (
        words.where(F.length("word") % 3 != 0)
        .distinct()
        .select("word", F.regexp_replace("word", "(ing|ed|s)$", "").alias("lemma"))
    )
