"""One configuration object for the whole library.

Fixed values: the genre whitelist, the query templates, the question
starters and the metric constants are the ones whose exact text decides the
results, so they are stated here once, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for matching results)
# ---------------------------------------------------------------------------

# Whitelisted genres, in list order (the first one missing from an entry is
# used for the negative query).
GENRES = ("Fantasy", "Science Fiction", "Horror", "Mystery", "Romance")

# Query templates. {genre}, {theme} and {keywords} are substituted.
GENRE_TEMPLATE = "Find a {genre} writing prompt"
THEME_TEMPLATE = "Find a {genre} prompt about {theme}"
THEME_TEMPLATE_ALT = "Find a {genre} story about {theme}"
KEYWORD_TEMPLATE = "Find a writing prompt about {keywords}"
NEGATIVE_TEMPLATE = "Find a {genre} writing prompt"

# Leading phrases removed from generated queries, applied one after the other
# in this order, case-insensitively.
QUESTION_STARTERS = (
    "can you", "could you", "would you", "i need", "i want",
    "i'm looking for", "show me", "find me", "give me",
    "what are", "what is", "how to", "where can", "tell me about",
    "provide", "generate", "recommend", "suggest",
)

# Request template for the external query-generation service; the body of
# the document replaces {prompt_text}.
REQUEST_TEMPLATE = """
Given the following writing prompt text:
---------------------
{prompt_text}
---------------------

Generate 1 to 3 relevant, concise search queries or keywords that someone might use to find this specific prompt.
Focus on the key themes, objects, characters, or concepts. Do NOT make them overly long or conversational.
Output each query on a new line, without any numbering or bullet points.

Example Input Prompt:
<Fantasy> </Fantasy> <Magic> </Magic> <The Accidental Alchemist> </The Accidental Alchemist> prompt A clumsy apprentice baker accidentally creates a potion that grants temporary, unpredictable magical abilities instead of a perfect sourdough starter.

Example Output Queries:
accidental magic potion baker
clumsy baker magic potion
temporary magic baking accident

Your turn:
"""

# Simulated RAG metrics: name, scale on the similarity, half-width of the
# uniform noise. Order is the report order.
SIMULATED_METRICS = (
    ("simulated_context_precision", 0.8, 0.1),
    ("simulated_context_recall", 0.9, 0.05),
    ("simulated_faithfulness", 0.7, 0.15),
    ("simulated_answer_relevancy", 0.85, 0.1),
)

# Example queries run against the best model in the leaderboard report.
EXAMPLE_QUERIES = (
    "Find a fantasy story about magic and potions",
    "A horror story with a supernatural twist",
    "Romance in a bookstore",
    "Science fiction about time travel",
)

# Metric names of the two retrieval-metric families, in report order.
RETRIEVAL_METRICS = ("precision@1", "precision@3", "precision@5", "mrr", "ndcg@5")

# Report headings, table heads and phrases, in report order.
LEADERBOARD_HEAD = ("# Prompt Retrieval Model Evaluation Report", "", "## Dataset Information")
DATASET_TEXT = ("- Total examples: %d\n- Evaluation date: %s\n- Dataset composition: "
                "{'positive_examples': %d, 'negative_examples': %d}")
LEADERBOARD_TABLE = ("", "## Model Comparison", "",
                     "| Model | Precision@1 | Precision@3 | Precision@5 | MRR | NDCG@5 |",
                     "|-------|------------|-------------|-------------|-----|--------|")
SELECTION_TEXT = ("\n## Selected Model: %s\n\n### Selection Rationale\n1. **Best Overall Performance**: %s "
                  "achieved the highest Mean Reciprocal Rank (MRR) of %s.\n2. **Precision**: P@1 %s, "
                  "P@3 %s, P@5 %s\n3. **NDCG@5**: %s\n\n### Example Queries and Results")
EXAMPLE_QUERY_TEXT = '\n#### Query: "%s"'
EXAMPLE_HIT_TEXT = "\n%d. **Score: %s**\n   ```\n   %s\n   ```"
COMPARISON_HEAD = "# Model Finetuning Comparison Report"
COMPARISON_TITLE = "Metrics Comparison (Simulated RAGAS)"
COMPARISON_TABLE = ("| Metric | Base Model | Finetuned Model | Absolute Improvement | Relative Improvement |",
                    "|--------|------------|-----------------|---------------------|--------------------|")
ANALYSIS_HEAD = ("", "## Analysis", "")
NO_RELATIVE_TEXT = "- Relative improvement calculation not applicable (base metrics might be zero)."
HIGHEST_TEXT = "- Highest relative improvement in **%s**: %s"
ONE_METRIC_TEXT = ("\n### Simulated Faithfulness Analysis\n- Base model %s: %s\n"
                   "- Finetuned model %s: %s\n- Absolute improvement: %s\n- Relative improvement: %s")

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EvalConfig:
    """Parameters shared by the operators. Everything is seeded."""

    seed: int = 42
    genres: tuple[str, ...] = GENRES
    genre_template: str = GENRE_TEMPLATE
    theme_template: str = THEME_TEMPLATE
    theme_template_alt: str = THEME_TEMPLATE_ALT
    keyword_template: str = KEYWORD_TEMPLATE
    negative_template: str = NEGATIVE_TEMPLATE
    starters: tuple[str, ...] = QUESTION_STARTERS
    request_template: str = REQUEST_TEMPLATE
    max_keywords: int = 3
    keyword_min_len: int = 5
    num_negatives: int = 3
    batch_size: int = 16
    top_k: int = 5
    simulated: tuple = field(default=SIMULATED_METRICS)

    def with_genres(self, genres) -> "EvalConfig":
        from dataclasses import replace
        return replace(self, genres=tuple(genres))


DEFAULT_CONFIG = EvalConfig()
