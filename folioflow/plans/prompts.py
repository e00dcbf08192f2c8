"""The texts that providers are asked with. ``{name}`` is filled from a column."""

PARSE = (
    "Split the text into its title and its items. Reply with one JSON object: homework_name (string), choice, short_answer and programming "
    "(lists of objects with id and question). Keep the wording of each item.\n\nText:\n{text}\n"
)
CHOICE = 'Answer each question with the letters of its right options. Reply with JSON: {"results": [{"id", "analysis", "answer"}]}.\nReferences:\n{references}\n\n{questions}'
SHORT = 'Answer each question in a few sentences. Reply with JSON: {"answers": [{"id", "analysis", "answer"}]}.\nReferences:\n{references}\n\n{questions}'
QUESTION = "Question {qid}: {question}\nContext: {context}\nFeedback: {feedback}\n"
REVIEW = "Question {qid}: {question}\nContext: {context}\nReferences: {references}\nAnswer: {answer}\nCheck the facts. Reply PASS if it is right, else say what is wrong.\n"
FEEDBACK = "Change the answers of this document as the remark asks, and nothing else. Reply with the whole document as JSON.\nDocument: {context}\nRemark: {remark}\n"
