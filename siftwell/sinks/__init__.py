"""Writers: digests as documents, feeds and dated archives, and the facade over the store."""
