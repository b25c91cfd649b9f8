"""Known datasets, models, dimensions and prompts. All tables here are configuration, held by the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.functions import text as tx


@dataclass(frozen=True)
class LabelTask:
    """One labelled dataset: where its results lie and which labels its answers may hold."""

    name: str
    file: str
    base_path: str
    label_map: Mapping[str, str] | None = None
    allowed: tuple[str, ...] | None = None
    label_col: str = "label"
    pred_col: str = "prediction"

    def labels(self) -> tuple[str, ...] | None:
        """Allowed labels: the given list, else the names of the label codes, else unknown (None)."""
        if self.allowed:
            return self.allowed
        return tuple(self.label_map.values()) if self.label_map else None


# ---------------------------------------------------------------------------------------------
# Result folders of the model variants, dataset files and label codes.
MODELS = {"base": "原始基座模型", "f": "F性格模型", "t": "T性格模型"}
POLARITY_CODES = {"0": "negative", "1": "positive"}
MARKET_CODES = {"0": "bearish", "1": "bullish", "2": "neutral"}

LABEL_TASKS = (
    LabelTask("imdb_sentiment", "imdb_sentiment_results.csv", "results/imdb_sentiment", POLARITY_CODES),
    LabelTask("mental_sentiment", "mental_sentiment_results.csv", "results/medical",
              allowed=("normal", "depression")),
    LabelTask("financial_sentiment", "news_sentiment_results.csv", "results/news", MARKET_CODES),
    LabelTask("fiqasa_sentiment", "fiqasa_results.csv", "results/finbench",
              allowed=("negative", "positive", "neutral"), label_col="answer"),
    LabelTask("imdb_sklearn", "imdb_sklearn_sentiment_results.csv", "results/sentiment/imdb_sklearn",
              POLARITY_CODES),
    LabelTask("sst2", "sst2_sentiment_results.csv", "results/sentiment/sst2", POLARITY_CODES),
)

# Files beside a result file: rows without a valid answer, their corrections, and the corrected results.
INVALID_SUFFIX = ".invalid.csv"
PROCESSED_SUFFIX = ".processed.csv"
CORRECTION_SUFFIX = {
    "imdb_sentiment": ".invalid.labeled.test.csv",
    "mental_sentiment": ".invalid.labeled.test.csv",
    "financial_sentiment": ".invalid.csv",
    "fiqasa_sentiment": ".invalid.csv",
    "sst2": ".invalid.csv",
}

# Case form that makes answers of each finance dataset comparable.
FINANCE_CASE = {
    "cfa_1000": "upper",
    "fiqasa": "lower",
    "german_400": "lower",
    "bigdata_1400": "capitalize",
    "headlines_2000": "capitalize",
}

# Answers that need no labeller, the labels a labeller may give, and its default.
RELABEL = {
    "imdb_sentiment": (("mixed", "neutral"), ("positive", "negative", "mixed"), "mixed"),
    "mental_sentiment": (("normal", "depression", "invalid"), ("normal", "depression", "invalid"), "invalid"),
}

# Questionnaire dimensions: id, name, the two letters and the two subtypes in file order.
DIMENSIONS = (
    (0, "energy", "E", "I", "extraversion", "introversion"),
    (1, "information", "N", "S", "intuition", "sensing"),
    (2, "decision", "T", "F", "thinking", "feeling"),
    (3, "execution", "J", "P", "judging", "perceiving"),
)
AXES = (("E", "I"), ("S", "N"), ("T", "F"), ("J", "P"))
LETTERS = ("E", "I", "S", "N", "T", "F", "J", "P")
NUM_TRIALS = 10
STOP_COUNT = 6
SCORE_CHOSEN, SCORE_REJECTED = 8, 1

# Prompt text by dataset; {name} stands for a column of the input row.
_POLARITY_END = "Review:\n{text}\n\nSentiment:"
PROMPTS = {
    "gsm8k": "Solve the following math problem and output only the final number answer.\n\n"
             "{question}\n\nOnly respond with one word. like 8",
    "arc_easy": "Choose the correct option (A/B/C/D) for the following question.\n\n"
                "Question: {question}\nOptions:\n{choices}\n\nOnly respond with one word. like: A",
    "boolq": "Based on the passage, answer whether the question is true or false.\n\n"
             "Passage: {passage}\n\nQuestion: {question}\n\nOnly respond with one word. like: true",
    "german_400": "{text}\n\nOnly respond with one word: good or bad. For example: good",
    "convfinqa_300": "{text}\n\nOnly respond with one word. For example: 32.18",
    "cfa_1000": "{text}\n\nOnly respond with one word. For example: C",
    "fiqasa": "You are a financial sentiment classifier. Respond with only one word: "
              "either 'positive', 'neutral', or 'negative'.\n\n{text}",
    "bigdata_1400": "{text}\n\nKindly confirm with only one word: Rise or Fall. For example: Rise",
    "headlines_2000": "{text}\n\nOnly respond with one word: Yes or No. For example: No",
    "imdb": "You are a movie review sentiment classifier. Classify the following review as either positive "
            "or negative. Respond with only one word: positive or negative.\n\n" + _POLARITY_END,
    "imdb_test": "You are a movie review sentiment classifier. Respond with only one word: positive or "
                 "negative.\n\n" + _POLARITY_END,
    "rotten": "You are a movie review sentiment classifier. Respond with only one word: positive or "
              "negative.\n\n" + _POLARITY_END,
    "sst2": "You are a sentence-level sentiment analysis model. Classify the sentiment of the sentence as "
            "positive or negative. Respond with only one word: positive or negative.\n\n"
            "Sentence:\n{text}\n\nSentiment:",
    "imdb_sklearn": "You are a sentiment classifier trained on user-written movie reviews. Please judge whether "
                    "the sentiment of the following review is positive or negative. Only respond with: positive "
                    "or negative.\n\nMovie Review:\n{text}\n\nSentiment:",
    "news": "You are analyzing financial news headlines. Each headline reflects a short financial opinion or "
            "fact. Please classify the overall sentiment into one of the following categories:\n- Bearish\n"
            "- Bullish\n- Neutral\n\nRespond with one word only.\n\nExample:\nText: $GM -- GM loses a bull\n"
            "Answer: Bearish\n\nNow classify the following:\n{text}\nAnswer:",
    "news_sentiment": "You are analyzing financial news headlines. Each headline reflects a short financial "
                      "opinion or fact.\nPlease classify the overall sentiment into one of the following "
                      "categories:\n- Bearish\n- Bullish\n- Neutral\n\nRespond with one word only.\n\nExample:\n"
                      "Text: $GM - GM loses a bull\nAnswer: Bearish\n\nNow classify the following:\n"
                      "\nText: {text}\nAnswer:",
    "mental": "You are given a short social media post that may reflect the mental state of the writer. Please "
              "classify it as either Normal or Depression based on the emotional content.\n\nText: {text}\n\n"
              "Respond with a single word: Normal or Depression.",
    "mental_sentiment": "You are given a short social media post that may reflect the mental state of the "
                        "writer. \n        Please classify it as either Normal or Depression based on the "
                        "emotional content.\n\nText: {text}\n\nRespond with a single word: Normal or Depression.",
    "edtsum": "Summarize the following content in no more than 3 sentences.\n\n{query}",
    "edtsum_plain": "{query}",
    "movie": "Summarize the movie plot below in no more than 4 sentences.\n\n{Plot}",
    "movie_summary": "You are a helpful assistant that writes short summaries for movie plots.\n\n"
                     "Plot:\n{Plot}\n\nSummary:",
    "meqsum": "The following is a detailed message from a patient regarding their medical concerns. Your task is "
              "to generate a short and informative one-sentence summary that captures the core question or "
              "intent.\n\nMessage: {CHQ}\n\nSummary:",
    # The example pair of this prompt is text of a third party; the caller gives it as two columns.
    "news_summary": "You are given a full news article from CNN. Your job is to summarize it into a short "
                    "highlight (1–3 sentences), similar to a brief bullet point.\n\nExample:\n"
                    "Article: {example_article}\nHighlight: {example_highlight}\n\n"
                    "Now summarize the following article:\n\nArticle: {article}\nHighlight:",
    "questionnaire": "You are answering an MBTI personality test.\nFor the question, select either choice_a or "
                     "choice_b.\nRespond with only one word: 'a' or 'b'.\n\nQ{number}: {question}\n"
                     "A: {text_a} (a)\nB: {text_b} (b)",
    "order_probe": "Pretend you are a real human being. Answer as if you were truly a person with preferences."
                   "\n\n{question}\n\n1. {option_1}\n2. {option_2}\n\n"
                   "Which one fits you better? Reply with the full sentence.",
}
# Datasets whose text is stripped first, and those that also lose a closing "Answer:".
STRIPPED = {"news_sentiment", "mental_sentiment", "edtsum", "edtsum_plain", "movie", "meqsum", "news_summary"}
CUE_DROPPED = {"german_400", "convfinqa_300", "cfa_1000", "fiqasa_bench", "bigdata_1400", "headlines_2000"}
# ---------------------------------------------------------------------------------------------

PROMPTS["fiqasa_bench"] = PROMPTS["fiqasa"]


def sibling(task: LabelTask, suffix: str) -> LabelTask:
    """the same dataset read from the file with another suffix."""
    return replace(task, file=task.file.replace(".csv", suffix))


def prompt(template: str, clean=None) -> Column:
    """the text of one template, with ``{name}`` filled from columns.

    ``clean`` is a Column-to-Column function put on every inserted column (U4).
    """
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = F.col(name).cast("string")
        parts += [F.lit(before), clean(value) if clean else value]
    return F.concat(*parts, F.lit(rest))


def prompt_for(name: str) -> Column:
    """the prompt of one known dataset."""
    if name not in PROMPTS:
        raise ValueError(f"unsupported dataset: {name}")
    clean = tx.drop_answer_cue if name in CUE_DROPPED else tx.strip if name in STRIPPED else None
    return prompt(PROMPTS[name], clean)


def prompt_by_dataset(names: Sequence[str], dataset: str = "dataset", fallback: str | None = None) -> Column:
    """the prompt switched on the dataset column; other datasets raise, or fall back to a plain column."""
    out = F
    for name in names:
        out = out.when(F.col(dataset) == name, prompt_for(name))
    if fallback is not None:
        return out.otherwise(F.col(fallback))
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported dataset: "), F.col(dataset))))


def opposite_subtype(dimension: str, preferred: str) -> str:
    """the other subtype of a dimension."""
    for _, name, _, _, first, second in DIMENSIONS:
        if name == dimension:
            if preferred not in (first, second):
                raise ValueError(f"{preferred} must be one of {(first, second)}")
            return second if preferred == first else first
    raise ValueError(f"unknown dimension: {dimension}")


def dimension_of(dim_id: int) -> tuple[str, str, str]:
    """dimension name and its two subtypes, by id."""
    for number, name, _, _, first, second in DIMENSIONS:
        if number == dim_id:
            return name, first, second
    raise ValueError(f"unknown dimension id: {dim_id}")


def opposite_subtype_column(subtype: Column | str) -> Column:
    """F24 as a column: the opposite of each known subtype, null for others."""
    pairs = {}
    for _, _, _, _, first, second in DIMENSIONS:
        pairs |= {first: second, second: first}
    return tx.map_label(subtype, pairs)


def by_dataset(dataset: Column | str, cases: Mapping[str, Column], otherwise: Column | None = None) -> Column:
    """One expression per dataset, chosen by the dataset column."""
    name = F.col(dataset) if isinstance(dataset, str) else dataset
    out = F
    for key, value in cases.items():
        out = out.when(name == key, value)
    return out if otherwise is None else out.otherwise(otherwise)
