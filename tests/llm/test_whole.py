"""What earlier cuts left out: ids of added tokens, text of figures, and whole runs in the pipeline's lines."""

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tessella.llm import extraction, packing

from .plain_lines import edited


def test_added_tokens_have_the_ids_of_the_library():
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = ["x<|endoftext|>", "<|endoftext|>", "a  b<|endoftext|> c", "no token < | > here", "<|endoftext|" * 3]
    for t, ids in zip(texts, packing.ByteLevelBPE(path)(texts), strict=True):
        assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, packing.END]
    assert packing.ByteLevelBPE(path)(texts)[0].tolist() == [87, 50256, 0]


@pytest.mark.parametrize(
    "part",
    [
        '<figure><svg viewBox="0 0 9 9"><g><text x="1">A label of the figure</text></g></svg></figure>',
        "<noscript><p>A label of the figure</p></noscript>",
        '<object data="x.swf"><p>A label of the figure</p></object>',
        "<video src=x><p>A label of the figure</p></video>",
        '<div class="related-work"><p>A label of the figure</p></div>',
        '<p id="form-and-function">A label of the figure</p>',
    ],
)
def test_text_of_the_article_stays(part):
    own = "The first paragraph of the article is as long as it has to be for anyone to see that it is one of the article and not of a menu."
    page = f"<html><body><nav>Menu</nav><article><p>{own}</p>{part}<p>{own}</p></article></body></html>"
    assert extraction.extract(page) == f"{own}\nA label of the figure\n{own}"


@pytest.mark.parametrize("part", ['<div class="related-posts"><p>More of this</p></div>', "<form><p>Your name</p></form>", "<script>var a</script>", '<div class="ad">Buy</div>', '<section id="comments"><p>So true</p></section>', '<div class="newsletter signupBox">Join</div>'])
def test_what_is_not_the_article_goes(part):
    own = "The first paragraph of the article is as long as it has to be for anyone to see that it is one of the article and not of a menu."
    assert extraction.extract(f"<article><p>{own}</p>{part}<p>{own}</p></article>") == f"{own}\n{own}"


def test_lines_stage_leaves_no_repeated_run(spark, sf):
    """All of documents: the stage's texts are those of plain Python, chunks and runs alike."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_lines(spark, docs, sf).collect()}
    assert got == edited(rows)
