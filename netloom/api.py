"""Everything a user needs in one namespace: `from netloom.api import *`."""

from netloom.operators.constraint import MeekRules, SepSets
from netloom.operators.factors import CKDE, HCKDE, MLE, Args, Arguments, Assignment, CKDEType, CLinearGaussianCPD, DiscreteFactor, DiscreteFactorParams, DiscreteFactorType, Factor, FactorType, Kwargs, LinearGaussianCPD, LinearGaussianCPDType, LinearGaussianParams, UnknownFactorType
from netloom.operators.graph import ConditionalDag, ConditionalDirectedGraph, ConditionalPartiallyDirectedGraph, ConditionalUndirectedGraph, Dag, DirectedGraph, PartiallyDirectedGraph, UndirectedGraph
from netloom.operators.independence import ChiSquare, DynamicChiSquare, DynamicIndependenceTest, DynamicKMutualInformation, DynamicLinearCorrelation, DynamicMutualInformation, DynamicRCoT, IndependenceTest, KMutualInformation, LinearCorrelation, MutualInformation, RCoT, TestTable
from netloom.operators.kde import KDE, UCV, BandwidthSelector, NormalReferenceRule, ProductKDE, ScottsBandwidth, SingularCovarianceData, UCVScorer
from netloom.operators.learn import DMMHC, MMHC, MMPC, PC, Callback, GreedyHillClimbing, hc
from netloom.operators.models import (
    BayesianNetwork, BayesianNetworkType, CLGNetwork, CLGNetworkType, ConditionalBayesianNetwork, ConditionalCLGNetwork, ConditionalDiscreteBN, ConditionalGaussianNetwork, ConditionalHeterogeneousBN,
    ConditionalHomogeneousBN, ConditionalKDENetwork, ConditionalSemiparametricBN, DiscreteBN, DiscreteBNType, DynamicBayesianNetwork, DynamicCLGNetwork, DynamicDiscreteBN, DynamicGaussianNetwork,
    DynamicHeterogeneousBN, DynamicHomogeneousBN, DynamicKDENetwork, DynamicSemiparametricBN, GaussianNetwork, GaussianNetworkType, HeterogeneousBN, HeterogeneousBNType, HomogeneousBN, HomogeneousBNType,
    KDENetwork, KDENetworkType, SemiparametricBN, SemiparametricBNType,
)
from netloom.operators.scores import BDe, BGe, BIC, CVLikelihood, DynamicBDe, DynamicBGe, DynamicBIC, DynamicCVLikelihood, DynamicHoldoutLikelihood, DynamicScore, DynamicValidatedLikelihood, HoldoutLikelihood, Score, ValidatedLikelihood, ValidatedScore
from netloom.operators.search import AddArc, ArcOperatorSet, ChangeNodeType, ChangeNodeTypeSet, FlipArc, LocalScoreCache, Operator, OperatorPool, OperatorSet, OperatorTabuSet, RemoveArc
from netloom.operators.split import CrossValidation, HoldOut
from netloom.operators.temporal import DynamicDataFrame, temporal_name
from netloom.sources.dataset import Dataset, from_arrow, from_pandas
from netloom.sources.folder import load_folder, save_folder
from netloom.sources.serialization import SaveModel, load, save
from netloom.streaming.scoring import StreamingMoments, score_stream

__all__ = [n for n in dir() if not n.startswith("_") and n != "netloom"]
