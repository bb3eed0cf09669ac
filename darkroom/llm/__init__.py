"""Corpus operators: what it takes to turn the service's step texts and prompts into training data.

Every operator works on the service's own records (``job_steps.detail``, ``eval_results.prompt``,
``artifacts``) and names its columns as parameters. Operators read the named columns only, so
other columns of any name may be present; they return their own columns. Nothing outside this
folder imports it.
"""
