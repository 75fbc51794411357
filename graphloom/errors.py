"""Errors with stable codes, so that callers can tell them apart."""

from __future__ import annotations

# Codes of a remote call, general ones first, then those of graphs.
CODES = {
    "parse_error": -32700,
    "invalid_request": -32600,
    "method_not_found": -32601,
    "invalid_params": -32602,
    "internal_error": -32603,
    "graph_not_found": -32001,
    "node_not_found": -32002,
    "edge_not_found": -32003,
    "graph_already_exists": -32004,
    "invalid_graph_id": -32005,
    "invalid_node_id": -32006,
    "invalid_edge": -32007,
    "graph_operation_failed": -32008,
    "algorithm_error": -32009,
    "validation_error": -32010,
    "resource_limit_exceeded": -32011,
    "server_not_initialized": -32012,
}


class GraphError(Exception):
    """Base of all errors of the engine; ``code`` is what a remote caller sees."""

    code = CODES["internal_error"]

    def as_dict(self) -> dict:
        """Code and message as a remote caller gets them."""
        return {"code": self.code, "message": str(self)}


class ValidationError(GraphError, ValueError):
    """An argument is out of range."""

    code = CODES["validation_error"]


class InvalidParamsError(ValidationError):
    """An argument is missing, unknown or of the wrong kind."""

    code = CODES["invalid_params"]


class UnknownToolError(ValidationError):
    """No tool of that name."""

    code = CODES["method_not_found"]


class InvalidRequestError(GraphError):
    """The call isn't a request at all."""

    code = CODES["invalid_request"]


class ParseError(GraphError):
    """The text of a request can't be read."""

    code = CODES["parse_error"]


class GraphNotFoundError(GraphError):
    """No graph of that name."""

    code = CODES["graph_not_found"]


class NodeNotFoundError(GraphError):
    """A vertex that isn't in the graph."""

    code = CODES["node_not_found"]


class EdgeNotFoundError(GraphError):
    """An edge that isn't in the graph."""

    code = CODES["edge_not_found"]


class GraphAlreadyExistsError(GraphError):
    """The name is taken."""

    code = CODES["graph_already_exists"]


class InvalidGraphIdError(ValidationError):
    """A text that can't name a graph."""

    code = CODES["invalid_graph_id"]


class InvalidNodeIdError(ValidationError):
    """A value that can't be a vertex."""

    code = CODES["invalid_node_id"]


class InvalidEdgeError(ValidationError):
    """A value that isn't an edge: two ends and, at most, a dictionary of attributes."""

    code = CODES["invalid_edge"]


class GraphOperationError(GraphError):
    """The operation isn't defined for this graph (direction, cycles)."""

    code = CODES["graph_operation_failed"]


class AlgorithmError(GraphError):
    """The algorithm has no result (no path, unbounded flow, no convergence)."""

    code = CODES["algorithm_error"]


class ResourceLimitError(GraphError):
    """A guard on sizes refused the call."""

    code = CODES["resource_limit_exceeded"]


class NotInitializedError(GraphError):
    """A call before the engine was set up, or after its session ended."""

    code = CODES["server_not_initialized"]


#: Guards that callers may change: vertices and edges a call, vertices laid out, vertices a
#: component may have for a kernel that works on one component at a time, sources of all-pairs,
#: characters and edges of a CSV text.
LIMITS = {"nodes_per_call": 100_000, "edges_per_call": 500_000, "layout_nodes": 10_000, "component_nodes": 50_000, "all_pairs_nodes": 1_000, "csv_chars": 10_000_000, "csv_edges": 500_000}


def graph_name(name: object) -> str:
    """A valid graph name: 1 to 100 letters, digits, underscores or hyphens."""
    text = name.strip() if isinstance(name, str) else ""
    if not text or len(text) > 100 or not all(c.isalnum() or c in "_-" for c in text):
        raise InvalidGraphIdError(f"not a graph name: {name!r}")
    return text
