"""Bayesian networks: types and their rules, plain, conditional and dynamic networks; fitting, scoring and sampling of tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.factors import Arguments, CKDEType, DiscreteFactorType, Factor, FactorType, LinearGaussianCPDType, UnknownFactorType
from netloom.operators.graph import ConditionalDag, Dag
from netloom.operators.kde import score_rows
from netloom.operators.stats import SuffStats
from netloom.operators.temporal import DynamicDataFrame, temporal_name
from netloom.sources.dataset import Dataset

LG, DISCRETE, KERNEL, UNKNOWN = LinearGaussianCPDType(), DiscreteFactorType(), CKDEType(), UnknownFactorType()


class BayesianNetworkType(ABC):
    """Rules of a kind of network. Subclass to plug in one's own."""

    def is_homogeneous(self) -> bool:
        return False

    @abstractmethod
    def default_node_type(self) -> FactorType: ...

    def data_default_node_type(self, data: Dataset, column: str) -> list[FactorType]:
        """Node types for a column, best first."""
        return [self.default_node_type()]

    def compatible_node_type(self, model, node: str, node_type: FactorType) -> bool:
        return True

    def can_have_arc(self, model, source: str, target: str) -> bool:
        return True

    def alternative_node_type(self, model, node: str) -> list[FactorType]:
        return []

    def new_bn(self, nodes: Sequence[str]) -> BayesianNetwork:
        return BayesianNetwork(self, nodes)

    def new_cbn(self, nodes: Sequence[str], interface_nodes: Sequence[str]) -> ConditionalBayesianNetwork:
        return ConditionalBayesianNetwork(self, nodes, interface_nodes)

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash(type(self).__qualname__)

    def __repr__(self) -> str:
        return type(self).__name__


class HomogeneousBNType(BayesianNetworkType):
    def __init__(self, factor_type: FactorType):
        self.factor_type = factor_type

    def is_homogeneous(self):
        return True

    def default_node_type(self):
        return self.factor_type

    def compatible_node_type(self, model, node, node_type):
        return node_type == self.factor_type


class _Fixed(HomogeneousBNType):
    factor: FactorType

    def __init__(self):
        super().__init__(self.factor)


class GaussianNetworkType(_Fixed):
    factor = LG

    def new_bn(self, nodes):
        return GaussianNetwork(nodes)


class DiscreteBNType(_Fixed):
    factor = DISCRETE

    def new_bn(self, nodes):
        return DiscreteBN(nodes)


class KDENetworkType(_Fixed):
    factor = KERNEL

    def new_bn(self, nodes):
        return KDENetwork(nodes)


class SemiparametricBNType(BayesianNetworkType):
    """Linear-Gaussian or kernel nodes, and discrete ones; a discrete node has discrete parents only."""

    def default_node_type(self):
        return UNKNOWN

    def data_default_node_type(self, data, column):
        return [DISCRETE] if data.is_discrete(column) else [LG, KERNEL]

    def compatible_node_type(self, model, node, node_type):
        if node_type not in (LG, KERNEL, DISCRETE):
            return False
        if node_type == DISCRETE:
            return all(model.node_type(p) in (DISCRETE, UNKNOWN) for p in model.parents(node))
        return all(model.node_type(c) != DISCRETE for c in model.children(node))

    def can_have_arc(self, model, source, target):
        return model.node_type(target) != DISCRETE or model.node_type(source) in (DISCRETE, UNKNOWN)

    def alternative_node_type(self, model, node):
        return {LG: [KERNEL], KERNEL: [LG]}.get(model.node_type(node), [])

    def new_bn(self, nodes):
        return SemiparametricBN(nodes)


class CLGNetworkType(BayesianNetworkType):
    """Conditional linear-Gaussian: continuous nodes may not be parents of discrete ones."""

    def default_node_type(self):
        return UNKNOWN

    def data_default_node_type(self, data, column):
        return [DISCRETE] if data.is_discrete(column) else [LG]

    def compatible_node_type(self, model, node, node_type):
        if node_type == DISCRETE:
            return all(model.node_type(p) in (DISCRETE, UNKNOWN) for p in model.parents(node))
        return node_type == LG and all(model.node_type(c) != DISCRETE for c in model.children(node))

    def can_have_arc(self, model, source, target):
        return model.node_type(source) != LG or model.node_type(target) != DISCRETE

    def new_bn(self, nodes):
        return CLGNetwork(nodes)


class HeterogeneousBNType(BayesianNetworkType):
    """A list of types for all columns, or lists by kind of column: "continuous", "discrete", or a Spark type name."""

    def __init__(self, types: Sequence[FactorType] | dict[str, Sequence[FactorType]]):
        self.types = {k: list(v) for k, v in types.items()} if isinstance(types, dict) else list(types)

    def default_node_type(self):
        return self.types[0] if isinstance(self.types, list) and len(self.types) == 1 else UNKNOWN

    def data_default_node_type(self, data, column):
        if isinstance(self.types, list):
            return list(self.types)
        kind = data.df.schema[column].dataType.typeName()
        key = kind if kind in self.types else "discrete" if data.is_discrete(column) else "continuous"
        if key not in self.types:
            raise ValueError(f"no node type for {kind} columns")
        return list(self.types[key])

    def alternative_node_type(self, model, node):
        now = model.node_type(node)
        groups = [self.types] if isinstance(self.types, list) else list(self.types.values())
        return [t for g in groups if now in g for t in g if t != now]


class BayesianNetwork:
    """A graph, a type for each node, and a factor for each node once fitted."""

    conditional = False
    default_type: BayesianNetworkType | None = None

    def __init__(self, bn_type: BayesianNetworkType, nodes: Sequence = (), arcs: Sequence[tuple[str, str]] = (), node_types: Sequence[tuple[str, FactorType]] = (), graph: Dag | None = None, interface_nodes: Sequence[str] = ()):
        self._type, self.include_cpd = bn_type, False
        if isinstance(nodes, (Dag, ConditionalDag)):
            graph, nodes = nodes, ()
        if nodes and isinstance(nodes[0], tuple):
            nodes, arcs = (), nodes
        if graph is None:
            names = list(nodes) or list(dict.fromkeys(x for a in arcs for x in a if x not in interface_nodes))
            graph = ConditionalDag(names, list(interface_nodes)) if self.conditional else Dag(names)
        else:
            graph = graph.clone()
        self._graph = graph
        self._types: dict[str, FactorType] = dict(node_types)
        self._cpds: dict[str, Factor] = {}
        for n, t in self._types.items():
            self._known(n)
            if bn_type.is_homogeneous() and t != bn_type.default_node_type():
                raise ValueError(f"{bn_type} nodes are {bn_type.default_node_type()}")
        for a, b in arcs:
            self.add_arc(a, b)
        for a, b in graph.arcs():
            if not bn_type.can_have_arc(self, a, b):
                raise ValueError(f"{bn_type} cannot have the arc {a} -> {b}")

    # ---- graph
    def graph(self):
        return self._graph

    def type(self) -> BayesianNetworkType:
        return self._type

    def __getattr__(self, name):
        # node and arc queries are the graph's
        if name.startswith("_") or name not in PASSED:
            raise AttributeError(name)
        return getattr(self._graph, name)

    def _known(self, node: str) -> None:
        if not self._graph.contains_joint_node(node):
            raise ValueError(f"no node {node}")

    def add_node(self, node: str) -> int:
        return self._graph.add_node(node)

    def remove_node(self, node: str) -> None:
        for c in self._graph.children(node):
            self._cpds.pop(c, None)
        self._graph.remove_node(node)
        self._types.pop(node, None)
        self._cpds.pop(node, None)

    def add_arc(self, a: str, b: str) -> None:
        if not self._type.can_have_arc(self, a, b):
            raise ValueError(f"{self._type} cannot have the arc {a} -> {b}")
        self._graph.add_arc(a, b)

    def remove_arc(self, a: str, b: str) -> None:
        self._graph.remove_arc(a, b)

    def flip_arc(self, a: str, b: str) -> None:
        if not self._type.can_have_arc(self, b, a):
            raise ValueError(f"{self._type} cannot have the arc {b} -> {a}")
        self._graph.flip_arc(a, b)

    def can_add_arc(self, a: str, b: str) -> bool:
        return self._graph.can_add_arc(a, b) and self._type.can_have_arc(self, a, b)

    def can_flip_arc(self, a: str, b: str) -> bool:
        return self._graph.can_flip_arc(a, b) and self._type.can_have_arc(self, b, a)

    def check_blacklist(self, arcs: Iterable[tuple[str, str]]) -> None:
        if bad := [a for a in arcs if self._graph.has_arc(*a)]:
            raise ValueError(f"blacklisted arcs are in the network: {bad}")

    def force_whitelist(self, arcs: Iterable[tuple[str, str]]) -> None:
        for a, b in arcs:
            if not self._graph.has_arc(a, b):
                if self._graph.has_arc(b, a):
                    raise ValueError(f"whitelisted arc {a} -> {b} is there reversed")
                self.add_arc(a, b)

    # ---- types
    def node_type(self, node: str) -> FactorType:
        self._known(node)
        return self._types.get(node, self._type.default_node_type())

    def node_types(self) -> dict[str, FactorType]:
        return {n: self.node_type(n) for n in self._graph.joint_nodes()}

    def set_node_type(self, node: str, node_type: FactorType) -> None:
        if self._type.is_homogeneous() and node_type != self._type.default_node_type():
            raise ValueError(f"{self._type} nodes are {self._type.default_node_type()}")
        if not self._type.compatible_node_type(self, node, node_type):
            raise ValueError(f"{node} cannot be {node_type}")
        self._types[node] = node_type
        if node in self._cpds and self._cpds[node].type() != node_type:
            del self._cpds[node]

    def underlying_node_type(self, data, node: str) -> FactorType:
        """The node's type, or the first that suits its column if it is unknown."""
        t = self.node_type(node)
        return t if t != UNKNOWN else self._type.data_default_node_type(Dataset.of(data), node)[0]

    def has_unknown_node_types(self) -> bool:
        return any(t == UNKNOWN for t in self.node_types().values())

    def set_unknown_node_types(self, data, type_blacklist: Iterable[tuple[str, FactorType]] = ()) -> None:
        data, banned = Dataset.of(data), set(type_blacklist)
        order = [*self._graph.interface_nodes(), *self._graph.topological_sort()]
        for n in order:
            if self.node_type(n) == UNKNOWN:
                options = [t for t in self._type.data_default_node_type(data, n) if (n, t) not in banned]
                fit = [t for t in options if self._type.compatible_node_type(self, n, t)]
                if not fit:
                    raise ValueError(f"no node type for {n}")
                self._types[n] = fit[0]

    def force_type_whitelist(self, types: Iterable[tuple[str, FactorType]]) -> None:
        for n, t in types:
            self.set_node_type(n, t)

    # ---- factors
    def cpd(self, node: str) -> Factor:
        if node not in self._cpds:
            raise ValueError(f"{node} is not fitted")
        return self._cpds[node]

    def add_cpds(self, cpds: Iterable[Factor]) -> None:
        cpds = list(cpds)
        for f in cpds:
            self._known(f.variable())
            if self._graph.is_interface(f.variable()):
                raise ValueError(f"{f.variable()} is an interface node")
            if set(f.evidence()) != set(self._graph.parents(f.variable())):
                raise ValueError(f"{f} does not match the parents {self._graph.parents(f.variable())}")
            if self.node_type(f.variable()) not in (f.type(), UNKNOWN):
                raise ValueError(f"{f.variable()} is {self.node_type(f.variable())}, not {f.type()}")
        for f in cpds:
            if self.node_type(f.variable()) == UNKNOWN:
                self._types[f.variable()] = f.type()
            self._cpds[f.variable()] = f

    def _usable(self, node: str) -> bool:
        f = self._cpds.get(node)
        return f is not None and f.fitted() and f.type() == self.node_type(node) and set(f.evidence()) == set(self._graph.parents(node))

    def fitted(self) -> bool:
        return all(self._usable(n) for n in self._graph.nodes())

    def fit(self, data, construction_args: Arguments | None = None, stats: SuffStats | None = None) -> BayesianNetwork:
        """Fits nodes that have no fitted factor for their present parents. All linear-Gaussian nodes share one job."""
        data = Dataset.of(data)
        data.raise_has_columns(self._graph.joint_nodes())
        self.set_unknown_node_types(data)
        stats, args = stats or SuffStats(data), construction_args or Arguments()
        todo = [n for n in self._graph.nodes() if not self._usable(n)]
        stats.prefetch([[n, *self._graph.parents(n)] for n in todo if self.node_type(n) == LG and not any(self.node_type(p) == DISCRETE for p in self._graph.parents(n))])
        for n in todo:
            t = self.node_type(n)
            a, k = args.args(n, t)
            self._cpds[n] = t.new_factor(self, n, self._graph.parents(n), *a, **k).fit_from(stats)
        return self

    def _need_fitted(self) -> None:
        if not self.fitted():
            raise ValueError("the network is not fitted")

    def attach_logl(self, df: DataFrame, output: str = "logl", per_node: bool = False) -> DataFrame:
        """Column expressions for what can be one, and a single Arrow pass for all other nodes together."""
        self._need_fitted()
        names = {n: f"_l_{n}" for n in self._graph.nodes()}
        real, text, functions = [], [], {}
        for n in names:
            if (s := self._cpds[n].scorer()) is not None:
                real, text = list(dict.fromkeys([*real, *s[0]])), list(dict.fromkeys([*text, *s[1]]))
                functions[names[n]] = s[2]
            else:
                df = self._cpds[n].attach_logl(df, names[n])
        if functions:
            df = score_rows(df, real, functions, text, any(c.heavy() for c in self._cpds.values()))
        total = None
        for v in names.values():
            total = F.col(f"`{v}`") if total is None else total + F.col(f"`{v}`")
        df = df.withColumn(output, total if total is not None else F.lit(0.0))
        return df if per_node else df.drop(*names.values())

    def logl(self, data, output: str = "logl") -> DataFrame:
        """The rows with the sum of their nodes' log-likelihoods; null for rows with a null."""
        return self.attach_logl(Dataset.of(data).df, output)

    def slogl(self, data) -> float:
        """Sum over nodes of each node's sum over its valid rows: one job."""
        df = self.attach_logl(Dataset.of(data).df, "_all", per_node=True)
        names = [f"_l_{n}" for n in self._graph.nodes()]
        return float(sum(x or 0.0 for x in df.agg(*[F.sum(F.col(f"`{n}`")).alias(str(i)) for i, n in enumerate(names)]).first()))

    def sample(self, n: int, seed: int | None = None, ordered: bool = False) -> DataFrame:
        """Ancestral sampling; node i in topological order uses seed + i."""
        self._need_fitted()
        if n < 0:
            raise ValueError("a negative sample size")
        order = self._graph.topological_sort()
        df = SparkSession.active().range(n).select(F.lit(0).alias("_row"))
        for i, v in enumerate(order):
            df = self._cpds[v].attach_sample(df, (seed or 0) + 7919 * i)
        return df.select(*[F.col(f"`{c}`") for c in (self._graph.nodes() if ordered else order)])

    # ---- other forms
    def clone(self):
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out._graph, out._types, out._cpds = self._graph.clone(), dict(self._types), dict(self._cpds)
        return out

    def conditional_bn(self, nodes: Sequence[str] | None = None, interface_nodes: Sequence[str] | None = None) -> ConditionalBayesianNetwork:
        g = self._graph.conditional_graph(nodes, interface_nodes)
        out = ConditionalBayesianNetwork(self._type, graph=g, node_types=[(n, t) for n, t in self._types.items() if g.contains_joint_node(n)])
        out._cpds = {n: f for n, f in self._cpds.items() if g.contains_node(n) and set(f.evidence()) == set(g.parents(n))}
        return out

    def unconditional_bn(self) -> BayesianNetwork:
        out = BayesianNetwork(self._type, graph=self._graph.unconditional_graph(), node_types=list(self._types.items()))
        out._cpds = dict(self._cpds)
        return out

    def save(self, filename: str, include_cpd: bool = False) -> str:
        from netloom.sources.serialization import save

        return save(self, filename, include_cpd)

    def __getstate__(self):
        s = dict(self.__dict__)
        if not self.include_cpd:
            s["_cpds"] = {}
        return s

    def __setstate__(self, s):
        self.__dict__.update(s)

    def __str__(self) -> str:
        return f"{type(self).__name__}({self._type}; nodes {self._graph.nodes()}; arcs {self._graph.arcs()})"


PASSED = frozenset("""nodes num_nodes contains_node indices collapsed_indices name index collapsed_index collapsed_name index_from_collapsed collapsed_from_index is_valid
arcs num_arcs parents children num_parents num_children has_arc has_path roots leaves is_root is_leaf topological_sort interface_nodes joint_nodes num_interface_nodes
num_joint_nodes contains_interface_node contains_joint_node is_interface interface_arcs joint_collapsed_index interface_collapsed_index joint_collapsed_indices
interface_collapsed_indices joint_collapsed_name interface_collapsed_name add_interface_node remove_interface_node set_interface set_node""".split())


class ConditionalBayesianNetwork(BayesianNetwork):
    """A network given interface nodes, which have no parents and no factor."""

    conditional = True

    def __init__(self, bn_type: BayesianNetworkType, nodes: Sequence = (), interface_nodes: Sequence[str] = (), arcs: Sequence[tuple[str, str]] = (), node_types: Sequence[tuple[str, FactorType]] = (), graph=None):
        super().__init__(bn_type, nodes, arcs, node_types, graph, interface_nodes)

    def sample(self, evidence: DataFrame | None = None, seed: int | None = None, concat_evidence: bool = False, ordered: bool = False) -> DataFrame:
        """One draw of the nodes for each row of evidence."""
        self._need_fitted()
        if evidence is None or isinstance(evidence, int):
            raise ValueError("sampling a conditional network needs evidence")
        order, df = self._graph.topological_sort(), evidence
        for i, v in enumerate(order):
            df = self._cpds[v].attach_sample(df, (seed or 0) + 7919 * i)
        names = self._graph.nodes() if ordered else order
        return df.select(*[F.col(f"`{c}`") for c in ([*self._graph.interface_nodes(), *names] if concat_evidence else names)])


def _named(name: str, bn_type: type, base=BayesianNetwork):
    """Network classes whose type is given by their name."""
    if issubclass(base, ConditionalBayesianNetwork):
        def init(self, nodes=(), interface_nodes=(), arcs=(), node_types=(), graph=None):
            ConditionalBayesianNetwork.__init__(self, bn_type(), nodes, interface_nodes, arcs, node_types, graph)
    else:
        def init(self, nodes=(), arcs=(), node_types=(), graph=None):
            BayesianNetwork.__init__(self, bn_type(), nodes, arcs, node_types, graph)
    return type(name, (base,), {"__init__": init, "__module__": __name__})


GaussianNetwork = _named("GaussianNetwork", GaussianNetworkType)
DiscreteBN = _named("DiscreteBN", DiscreteBNType)
KDENetwork = _named("KDENetwork", KDENetworkType)
SemiparametricBN = _named("SemiparametricBN", SemiparametricBNType)
CLGNetwork = _named("CLGNetwork", CLGNetworkType)
ConditionalGaussianNetwork = _named("ConditionalGaussianNetwork", GaussianNetworkType, ConditionalBayesianNetwork)
ConditionalDiscreteBN = _named("ConditionalDiscreteBN", DiscreteBNType, ConditionalBayesianNetwork)
ConditionalKDENetwork = _named("ConditionalKDENetwork", KDENetworkType, ConditionalBayesianNetwork)
ConditionalSemiparametricBN = _named("ConditionalSemiparametricBN", SemiparametricBNType, ConditionalBayesianNetwork)
ConditionalCLGNetwork = _named("ConditionalCLGNetwork", CLGNetworkType, ConditionalBayesianNetwork)


class HomogeneousBN(BayesianNetwork):
    def __init__(self, factor_type: FactorType, nodes=(), arcs=(), graph=None):
        super().__init__(HomogeneousBNType(factor_type), nodes, arcs, (), graph)


class HeterogeneousBN(BayesianNetwork):
    def __init__(self, factor_types, nodes=(), arcs=(), node_types=(), graph=None):
        super().__init__(HeterogeneousBNType(factor_types), nodes, arcs, node_types, graph)


class ConditionalHomogeneousBN(ConditionalBayesianNetwork):
    def __init__(self, factor_type: FactorType, nodes=(), interface_nodes=(), arcs=(), graph=None):
        super().__init__(HomogeneousBNType(factor_type), nodes, interface_nodes, arcs, (), graph)


class ConditionalHeterogeneousBN(ConditionalBayesianNetwork):
    def __init__(self, factor_types, nodes=(), interface_nodes=(), arcs=(), node_types=(), graph=None):
        super().__init__(HeterogeneousBNType(factor_types), nodes, interface_nodes, arcs, node_types, graph)


class DynamicBayesianNetwork:
    """Variables over time: a static network over slices 1..m and a transition network of slice 0 given them."""

    def __init__(self, bn_type: BayesianNetworkType, variables: Sequence[str], markovian_order: int, static_bn: BayesianNetwork | None = None, transition_bn: ConditionalBayesianNetwork | None = None):
        if markovian_order < 1:
            raise ValueError("the Markov order is at least 1")
        self._type, self._variables, self.m, self.include_cpd = bn_type, list(variables), markovian_order, False
        past = [temporal_name(v, k) for v in variables for k in range(1, markovian_order + 1)]
        now = [temporal_name(v, 0) for v in variables]
        self._static = static_bn if static_bn is not None else bn_type.new_bn(past)
        self._transition = transition_bn if transition_bn is not None else bn_type.new_cbn(now, past)
        if set(self._static.nodes()) != set(past) or set(self._transition.nodes()) != set(now) or set(self._transition.interface_nodes()) != set(past):
            raise ValueError("the networks' nodes don't match the variables")

    def type(self) -> BayesianNetworkType:
        return self._type

    def markovian_order(self) -> int:
        return self.m

    def variables(self) -> list[str]:
        return list(self._variables)

    def num_variables(self) -> int:
        return len(self._variables)

    def contains_variable(self, v: str) -> bool:
        return v in self._variables

    def add_variable(self, v: str) -> None:
        if v in self._variables:
            raise ValueError(f"{v} is there already")
        self._variables.append(v)
        for k in range(1, self.m + 1):
            self._static.add_node(temporal_name(v, k))
            self._transition.graph().add_interface_node(temporal_name(v, k))
        self._transition.add_node(temporal_name(v, 0))

    def remove_variable(self, v: str) -> None:
        self._variables.remove(v)
        for k in range(1, self.m + 1):
            self._static.remove_node(temporal_name(v, k))
            self._transition.remove_node(temporal_name(v, k))
        self._transition.remove_node(temporal_name(v, 0))

    def static_bn(self) -> BayesianNetwork:
        return self._static

    def transition_bn(self) -> ConditionalBayesianNetwork:
        return self._transition

    def fitted(self) -> bool:
        return self._static.fitted() and self._transition.fitted()

    def _slices(self, data, order_by, series=()) -> DynamicDataFrame:
        return data if isinstance(data, DynamicDataFrame) else DynamicDataFrame(data, self.m, order_by, series)

    def fit(self, data, construction_args: Arguments | None = None, order_by: Sequence[str] | None = None) -> DynamicBayesianNetwork:
        d = self._slices(data, order_by)
        self._static.fit(d.static_df(), construction_args)
        self._transition.fit(d.transition_df(), construction_args)
        return self

    def logl(self, data, output: str = "logl", order_by: Sequence[str] | None = None) -> DataFrame:
        """Order columns and log-likelihood of each row. The static network scores the first m rows (row i as slice m - i,
        given the rows before it), the transition network the others."""
        d = self._slices(data, order_by)
        if not self.fitted():
            raise ValueError("the network is not fitted")
        order = [F.col(f"`{c}`") for c in d.order]
        later = self._transition.attach_logl(d.transition_df().df, output).select(*order, output)
        head = d.data.df.orderBy(*order).limit(self.m).select(*order, *[F.col(f"`{v}`") for v in self._variables]).collect()
        if len(head) < self.m:
            raise ValueError("fewer rows than the Markov order")
        row = {temporal_name(v, self.m - i): r[v] for i, r in enumerate(head) for v in self._variables}
        spark = d.data.df.sparkSession
        fields = {temporal_name(v, k): d.data.df.schema[v].dataType for v in self._variables for k in range(1, self.m + 1)}
        from pyspark.sql.types import StructField, StructType

        schema = StructType([StructField(n, t) for n, t in fields.items()])
        one = self._static.attach_logl(spark.createDataFrame([tuple(row[n] for n in fields)], schema), "_all", per_node=True).first()
        scores = []
        for i in range(self.m):
            parts = [one[f"_l_{temporal_name(v, self.m - i)}"] for v in self._variables]
            scores.append(None if any(p is None for p in parts) else float(sum(parts)))
        key = [d.data.df.schema[c] for c in d.order]
        first = spark.createDataFrame([(*[r[c] for c in d.order], s) for r, s in zip(head, scores, strict=True)], StructType([*key, StructField(output, later.schema[output].dataType)]))
        return first.unionByName(later)

    def slogl(self, data, order_by: Sequence[str] | None = None) -> float:
        return self.logl(data, "_l", order_by).agg(F.sum("_l")).first()[0] or 0.0

    def sample(self, n: int, seed: int | None = None, series: int | None = None) -> DataFrame:
        """n rows in order (`t` from 0), or n rows of each of so many independent series (column `series` from 0). Time is sequential, so a series is
        one task's, which draws a block of series together; tasks run side by side. Kernel densities whose training rows are a table are not
        drawn from."""
        from netloom.operators.sequential import draw_series

        if not self.fitted():
            raise ValueError("the network is not fitted")
        model = self.clone_fitted()
        text = {v for v in self._variables if self._transition.node_type(temporal_name(v, 0)) == DISCRETE}
        out = draw_series(SparkSession.active(), model, n, 1 if series is None else series, 0 if seed is None else seed, text)
        return out.drop("series") if series is None else out

    def clone_fitted(self) -> DynamicBayesianNetwork:
        """A copy whose pickled form keeps the factors."""
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.include_cpd = True
        return out

    def save(self, filename: str, include_cpd: bool = False) -> str:
        from netloom.sources.serialization import save

        return save(self, filename, include_cpd)

    def __getstate__(self):
        s = dict(self.__dict__)
        for k in ("_static", "_transition"):
            s[k] = s[k].clone()
            s[k].include_cpd = self.include_cpd
        return s

    def __setstate__(self, s):
        self.__dict__.update(s)

    def __str__(self) -> str:
        return f"{type(self).__name__}({self._type}; variables {self._variables}; order {self.m})"


def _dynamic(name: str, bn_type: type):
    def init(self, variables, markovian_order, static_bn=None, transition_bn=None):
        DynamicBayesianNetwork.__init__(self, bn_type(), variables, markovian_order, static_bn, transition_bn)

    return type(name, (DynamicBayesianNetwork,), {"__init__": init, "__module__": __name__})


DynamicGaussianNetwork = _dynamic("DynamicGaussianNetwork", GaussianNetworkType)
DynamicDiscreteBN = _dynamic("DynamicDiscreteBN", DiscreteBNType)
DynamicKDENetwork = _dynamic("DynamicKDENetwork", KDENetworkType)
DynamicSemiparametricBN = _dynamic("DynamicSemiparametricBN", SemiparametricBNType)
DynamicCLGNetwork = _dynamic("DynamicCLGNetwork", CLGNetworkType)


class DynamicHomogeneousBN(DynamicBayesianNetwork):
    def __init__(self, factor_type, variables, markovian_order, static_bn=None, transition_bn=None):
        super().__init__(HomogeneousBNType(factor_type), variables, markovian_order, static_bn, transition_bn)


class DynamicHeterogeneousBN(DynamicBayesianNetwork):
    def __init__(self, factor_types, variables, markovian_order, static_bn=None, transition_bn=None):
        super().__init__(HeterogeneousBNType(factor_types), variables, markovian_order, static_bn, transition_bn)
