"""Plans built of operators: the document pipeline, questions and relational reads."""
