"""Table operators. Each maps a ``DataFrame`` to a ``DataFrame``, batch or streaming alike."""
