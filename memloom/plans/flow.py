"""The five stages, add to score, as one lazily chained flow over a dialogue set; stage results are written between."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..ports import EmbeddingPort, FunctionPort, HashEmbedding, TextPort, complete, embedder

STEPS = ("add", "search", "answer", "eval", "score")


def step_range(start: str = "add", end: str = "score") -> tuple[str, ...]:
    """The steps from start to end, both included."""
    a, b = STEPS.index(start), STEPS.index(end)
    if b < a:
        raise ValueError(f"{end} comes before {start}")
    return STEPS[a : b + 1]


def _first_memory(prompt: str) -> str:
    """Stand-in answer: the text of the first memory that the prompt lists."""
    for line in prompt.split("\n"):
        if line.startswith("- "):
            return "Answer: " + line.split("] ", 1)[-1]
    return ""


@dataclass
class Flow:
    """Search backend: ``rag`` (vectors only), ``hybrid`` (BM25 and vectors) or ``lexical``."""

    backend: str = "hybrid"
    top_k: int = 5
    answerer: TextPort = field(default_factory=lambda: FunctionPort(_first_memory))
    embedding: EmbeddingPort = field(default_factory=HashEmbedding)

    def add(self, messages: DataFrame) -> DataFrame:
        """Memories (user_id, key, text, embedding), one per turn."""
        return messages.withColumn("embedding", embedder(self.embedding)(F.col("text")))

    def search(self, questions: DataFrame, memories: DataFrame) -> DataFrame:
        """Retrieval blocks per question."""
        q = questions.withColumn("embedding", embedder(self.embedding)(F.col("text")))
        if self.backend == "rag":
            found = R.cosine_topk(q, memories, self.top_k).withColumnRenamed("cosine", "score")
        elif self.backend == "hybrid":
            found = R.hybrid_recall(q, memories, self.top_k).withColumnRenamed("rrf", "score")
        elif self.backend == "lexical":
            found = R.lexical_topk(q, memories, self.top_k)
        else:
            raise ValueError(f"no backend {self.backend}")
        blocks = R.payload(found, memories)
        return questions.join(blocks, ["user_id", "qid"], "left")

    def answer(self, found: DataFrame) -> DataFrame:
        """Predicted answers; questions without a memory stay blank and call nothing."""
        lines = F.array_join(F.transform("selected", lambda m: F.concat(F.lit("- ["), m["id"].cast("string"), F.lit("] "), m["text"])), "\n")
        asked = found.withColumn("prompt", F.concat(F.lit("Memories:\n"), lines, F.lit("\nQuestion: "), F.col("text")))
        has = F.coalesce(F.size("selected") > 0, F.lit(False))
        told = complete(asked.where(has), "prompt", self.answerer, keep_errors=True)
        told = told.withColumn("predicted_answer", T.answer_postprocess(T.strip_thinking(F.col("reply")))).drop("reply", "prompt")
        blank = asked.where(~has).drop("prompt").withColumns({"error": F.lit(None).cast("string"), "predicted_answer": F.lit("")})
        return told.unionByName(blank)

    def evaluate(self, answered: DataFrame, references: DataFrame) -> DataFrame:
        """Token F1 and BLEU-1 against the best reference (user_id, qid, candidates)."""
        rows = answered.join(references, ["user_id", "qid"])
        best = E.best_of(rows, ["user_id", "qid"], "predicted_answer", "candidates")
        return rows.join(best, ["user_id", "qid"])

    def score(self, evaluated: DataFrame) -> DataFrame:
        return E.score_summary(evaluated.select(F.lit("").alias("category"), F.col("user_id").alias("conversation"), "f1_score", "bleu_score"))

    def run(self, spark: SparkSession, questions: DataFrame, memories: DataFrame, references: DataFrame, folder: str) -> DataFrame:
        """All stages; each is written to ``folder`` and read again, so no call is ever repeated."""

        def stored(df: DataFrame, step: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{step}")
            return spark.read.parquet(f"{folder}/{step}")

        m = stored(self.add(memories), "add")
        answered = stored(self.answer(stored(self.search(questions, m), "search")), "answer")
        return stored(self.score(stored(self.evaluate(answered, references), "eval")), "score")
