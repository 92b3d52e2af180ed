"""DataFrame → DataFrame operators: profiling, EDA, repair, cleaning, encoding,
splitting, learners and evaluation."""
