"""Sources and sinks: delimited files (with the read safeguards), binary file
census and sniffing, post-read cleanup, and writers for results and models."""
